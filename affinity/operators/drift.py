"""Interest drift: smoothed KL divergence per user, its summary, weekly.

Sparse evaluation of the dense formula: a slot where both distributions are
zero contributes ``sigma * log10(sigma / sigma) = 0``, so only the union of
the two supports is visited; the number of zero slots is ``D - support``.
Each user's support is at most D, so the per-user maps below are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.joins import join_small
from ..functions.kl import SIGMA
from ..sources.inputs import ItemTags
from .distribution import two_sided_counts


def _prob_map(dist: DataFrame, key: str | list[str], value: str = "prob") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return dist.filter(F.col(value) > 0).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("tag_idx", value))).alias("_m"))


def _smooth(v: Column, support: Column, n_tags: int) -> Column:
    zeros = F.lit(int(n_tags)) - support
    return F.when(v.isNull() | (v == 0.0), F.lit(SIGMA)).otherwise(
        v - zeros * F.lit(SIGMA) / support)


def kl_from_maps(mp: Column, mq: Column, n_tags: int) -> Column:
    """KL(p || q) over tag -> probability maps; NULL if a smoothed value <= 0."""
    sp, sq = F.size(mp), F.size(mq)

    def term(t):
        a = _smooth(F.try_element_at(mp, t), sp, n_tags)
        b = _smooth(F.try_element_at(mq, t), sq, n_tags)
        return F.when((a > 0) & (b > 0), a * F.log10(a / b))

    # in tag order, so that the sum is the same on every run
    terms = F.transform(F.array_sort(F.array_union(F.map_keys(mp), F.map_keys(mq))), term)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(~F.exists(terms, lambda t: t.isNull()), total)


def kl_divergence(old: DataFrame, new: DataFrame, n_tags: int, key: str = "up_id",
                  direction: str = "old_new") -> DataFrame:
    """(key, kl) for keys present in both long distributions.

    ``direction='old_new'`` is KL(old || new) as the reference computes it;
    ``'new_old'`` is the reading of its comment, KL(new || old).
    """
    p, q = (old, new) if direction == "old_new" else (new, old)
    if direction not in ("old_new", "new_old"):
        raise ValueError(f"direction must be 'old_new' or 'new_old', got {direction!r}")
    mp = _prob_map(p, key).withColumnRenamed("_m", "_p")
    mq = _prob_map(q, key).withColumnRenamed("_m", "_q")
    both = mp.join(mq, key)
    return both.select(key, kl_from_maps(F.col("_p"), F.col("_q"), n_tags).alias("kl"))


def kl_summary(kl: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(n_users, n_undefined, kl_min, kl_max, kl_avg, kl_var) [per group].

    ``kl_var`` is the population variance (the reference's E[x^2] - E[x]^2).
    Users whose KL is undefined are counted, not averaged.
    """
    aggs = [F.count(F.lit(1)).alias("n_users"),
            F.count_if(F.col("kl").isNull()).alias("n_undefined"),
            F.min("kl").alias("kl_min"), F.max("kl").alias("kl_max"),
            F.avg("kl").alias("kl_avg"), F.var_pop("kl").alias("kl_var")]
    if group:
        return kl.groupBy(*group).agg(*aggs)
    return kl.agg(*aggs)


def _count_maps(counts: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, _po, _pn): probability maps of keys that have counts on both sides (at most D entries)."""
    def entries(name):
        return F.map_from_entries(F.collect_list(F.when(F.col(name) > 0, F.struct("tag_idx", name))))
    maps = counts.groupBy(*keys).agg(entries(old).alias("_mo"), entries(new).alias("_mn"))
    both = maps.filter((F.size("_mo") > 0) & (F.size("_mn") > 0))
    return both.select(*keys, _normalise(F.col("_mo")).alias("_po"), _normalise(F.col("_mn")).alias("_pn"))


def _directed(direction: str) -> tuple[Column, Column]:
    if direction not in ("old_new", "new_old"):
        raise ValueError(f"direction must be 'old_new' or 'new_old', got {direction!r}")
    return (F.col("_po"), F.col("_pn")) if direction == "old_new" else (F.col("_pn"), F.col("_po"))


def user_drift(history: DataFrame, items: ItemTags, old: tuple, new: tuple,
               direction: str = "old_new") -> DataFrame:
    """O23 from events: (up_id, kl) between two (start, end) windows, one scan for both."""
    p, q = _directed(direction)
    maps = _count_maps(two_sided_counts(history, items, old, new), ["up_id"], "old", "new")
    return maps.select("up_id", kl_from_maps(p, q, items.n_tags).alias("kl"))


def weekly_drift(history: DataFrame, items: ItemTags, to_date, weeks: int,
                 offset_weeks: int = 0, direction: str = "old_new", window_days: int = 7) -> DataFrame:
    """Per window i < ``weeks`` the KL summary of before-window vs in-window.

    Window i spans ``[end_i - window_days, end_i]`` with ``end_i = to_date -
    window_days * (i + offset_weeks)``; "before" is every event up to its first
    day.  Boundary days belong to both sides (as in the reference).  There is
    one row per window, with zero users and NULL statistics where no user has
    events on both sides.  ``window_days=7`` gives the reference's weeks;
    another length is the documented reading of its size argument.

    One pass for all windows: events are reduced per (user, tag, window class),
    and counts are fanned out only to the windows in which the user was active
    (others have no in-window side), inside one partitioning by user.
    """
    t, w, o, days = as_date(to_date), int(weeks), int(offset_weeks), int(window_days)
    p, q = _directed(direction)
    # base = floor(delta / days) - offset; boundary days also fall into window
    # base - 1; "before" holds for windows 0 .. base - 1
    delta = F.datediff(F.lit(t), F.col("play_date"))
    classed = (history.filter(F.col("play_date") <= F.lit(t))
               .select("up_id", "video_id", F.least(F.floor(delta / days) - o, F.lit(w + 1)).alias("_base"),
                       ((delta % days) == 0).alias("_edge"))
               .filter(F.col("_base") >= 0).groupBy("up_id", "video_id", "_base", "_edge")
               .agg(F.count(F.lit(1)).alias("c")))
    tagged = join_small(classed, items.long.select("video_id", "tag_idx"), "video_id", size=items.long_size)
    base, edge = F.col("_base"), F.col("_edge")
    inside = F.filter(F.array(base, F.when(edge, base - 1)), lambda x: (x >= 0) & (x < w))
    grouped = (tagged.groupBy("up_id", "tag_idx", "_base", "_edge").agg(F.sum("c").alias("c"))
               .withColumn("_active", F.array_distinct(F.flatten(
                   F.collect_set(inside).over(Window.partitionBy("up_id"))))))
    counts = (grouped.select("up_id", "tag_idx", "c", base, edge, F.explode(
                  F.filter("_active", lambda x: x <= base)).alias("week"))
              .groupBy("up_id", "week", "tag_idx")
              .agg(F.sum(F.when(F.col("week") <= base - 1, F.col("c")).otherwise(0)).alias("n_old"),
                   F.sum(F.when((F.col("week") == base) | (edge & (F.col("week") == base - 1)),
                                F.col("c")).otherwise(0)).alias("n_new")))
    maps = _count_maps(counts, ["up_id", "week"], "n_old", "n_new")
    summary = kl_summary(maps.select("week", kl_from_maps(p, q, items.n_tags).alias("kl")), ["week"])
    every = history.sparkSession.range(w).select(F.col("id").alias("week"))
    end = F.date_sub(F.lit(t), ((F.col("week") + o) * days).cast("int"))
    return every.join(summary, "week", "left").select(
        F.col("week").cast("int").alias("week"), F.date_sub(end, days).alias("week_start"), end.alias("week_end"),
        F.coalesce("n_users", F.lit(0)).alias("n_users"), F.coalesce("n_undefined", F.lit(0)).alias("n_undefined"),
        "kl_min", "kl_max", "kl_avg", "kl_var")


def _normalise(m: Column) -> Column:
    total = F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.transform_values(m, lambda _, v: v / total)
