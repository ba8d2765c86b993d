"""Tag probability distributions per user or per label.

Long form ``(key, tag_idx, n, total, prob)``: ``n`` counts the key's events
in the window on items carrying the tag, ``total = sum(n)`` over the key and
``prob = n / total`` (one division, so equal counts give equal doubles).
Tags with no events have no row; the dense view fills them with 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_range
from ..functions.joins import join_small
from ..sources.inputs import ItemTags, label_column
from .tags import slots


def key_window(key: str) -> Window:
    """Per-key window ordered by tag index over the whole partition.

    Sampling uses the same partition and order with a running frame, so the
    optimizer collapses both into one sort of the (small) aggregated rows.
    """
    return (Window.partitionBy(key).orderBy("tag_idx")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _with_prob(counts: DataFrame, key: str) -> DataFrame:
    total = F.sum("n").over(key_window(key))
    return (counts.withColumn("total", total)
            .withColumn("prob", F.col("n") / F.col("total")))


def watched_pairs(history: DataFrame, start=None, end=None) -> DataFrame:
    """(up_id, video_id, c): events per pair in the window.

    Pre-aggregating before any join collapses repeat watches map-side, so a
    heavy user or a hot item reaches the joins as one row per pair.
    """
    return (history.filter(in_range(F.col("play_date"), start, end))
            .groupBy("up_id", "video_id").agg(F.count(F.lit(1)).alias("c")))


def counted_pairs(history: DataFrame, **windows) -> DataFrame:
    """(up_id, video_id, <name>...): one scan, one count per named (start, end) window.

    Every pair of the history is there (all of them count as seen), with 0 in
    windows that it has no event in.
    """
    counts = [F.count_if(F.coalesce(in_range(F.col("play_date"), lo, hi), F.lit(False))).alias(name)
              for name, (lo, hi) in windows.items()]
    return history.groupBy("up_id", "video_id").agg(*counts)


def pairs_in(pairs: DataFrame, name: str) -> DataFrame:
    """(up_id, video_id, c) of one window of ``counted_pairs``."""
    return pairs.filter(F.col(name) > 0).select("up_id", "video_id", F.col(name).alias("c"))


def _tag_counts(pairs: DataFrame, key: str, items: ItemTags, counts: tuple[str, ...] = ("c",)) -> DataFrame:
    """(key, tag_idx, n...) from (key, video_id, c...)."""
    tagged = join_small(pairs, items.long.select("video_id", "tag_idx"), "video_id", size=items.long_size)
    names = ("n",) if counts == ("c",) else counts
    return tagged.groupBy(key, "tag_idx").agg(*[F.sum(c).alias(n) for c, n in zip(counts, names)])


def user_distribution_of(pairs: DataFrame, items: ItemTags) -> DataFrame:
    """O9 from (up_id, video_id, c)."""
    return _with_prob(_tag_counts(pairs, "up_id", items), "up_id")


def label_distribution_of(label: str, profile: DataFrame, pairs: DataFrame, items: ItemTags) -> DataFrame:
    """O8 from (up_id, video_id, c)."""
    col = label_column(label)
    users = profile.select(F.col("id").alias("up_id"), col)
    by_label = pairs.join(users, "up_id").groupBy(col, "video_id").agg(F.sum("c").alias("c"))
    return _with_prob(_tag_counts(by_label, col, items), col)


def user_tag_distribution(history: DataFrame, items: ItemTags, start=None,
                          end=None) -> DataFrame:
    """(up_id, tag_idx, n, total, prob) over events in ``[start, end]``."""
    return user_distribution_of(watched_pairs(history, start, end), items)


def label_tag_distribution(label: str, profile: DataFrame, history: DataFrame,
                           items: ItemTags, start=None, end=None) -> DataFrame:
    """(<label column>, tag_idx, n, total, prob), label = city or phone.

    Events join the profile on ``up_id = id`` (every profile row of a user
    counts, as in the reference); a NULL label is its own group here and
    drops out later at the label join.
    """
    return label_distribution_of(label, profile, watched_pairs(history, start, end), items)


def two_sided_counts(history: DataFrame, items: ItemTags, old: tuple, new: tuple) -> DataFrame:
    """(up_id, tag_idx, old, new): tag counts of two windows from one scan of the events."""
    pairs = counted_pairs(history, old=old, new=new).filter("old > 0 OR new > 0")
    return _tag_counts(pairs, "up_id", items, ("old", "new"))


def dense_distribution(dist: DataFrame, key: str, n_tags: int) -> DataFrame:
    """(key, prob ARRAY<DOUBLE>) of length D, zero-filled.

    Collects at most D entries per key (the support), never a whole group of
    events.
    """
    entries = dist.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.col("tag_idx").alias("at"), F.col("prob").alias("value")))).alias("_e"))
    return entries.select(key, slots(F.col("_e"), n_tags, F.lit(0.0)).alias("prob"))


def long_from_dense(dense: DataFrame, key: str) -> DataFrame:
    """Dense (key, prob ARRAY<DOUBLE>) back to long form.

    Counts are unknown for a given vector: the probability itself is carried
    in ``n`` (DOUBLE), ``total`` is the vector's sum and ``prob`` keeps the
    given value, so scoring sums exactly the given probabilities.
    """
    exploded = (dense.select(key, F.posexplode("prob").alias("tag_idx", "n"))
                .filter(F.col("n") > 0)
                .withColumn("tag_idx", F.col("tag_idx").cast("int")))
    return (exploded.withColumn("total", F.sum("n").over(key_window(key)))
            .withColumn("prob", F.col("n")))
