"""Scoring, exclusion, ranking and the recommenders.

Plan shape (user recommender):

* a key's selected tags come out of the distribution window and are written
  once; users are then partitioned by ``up_id`` and stay in place;
* postings of the clicked items are broadcast when their measured size allows
  (else both sides are shuffled), so candidates are generated and scored
  without moving;
* the seen history is repartitioned by ``up_id`` and anti-joined
  (co-partitioned), the rank window reuses the same partitioning.

Candidates come from the score-floor generator in ``candidates.py``, at every
size.  Scores are integer sums divided once (``prob_sum = sum(n) / total``),
which makes ties exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, days_before
from ..functions.joins import Measured, join_small, write_measured
from ..session import cut_lineage
from ..sources.inputs import ItemTags, label_column
from .candidates import (bucket, buckets_to, is_integral, item_postings, ranked_by_counts,
                         top_candidates)
from .distribution import (counted_pairs, label_distribution_of, pairs_in, user_distribution_of)
from .popularity import pair_popularity
from .sampling import select_tags

RECENT, OLDER = 0, 1


def item_side(items: ItemTags, pop: DataFrame) -> DataFrame:
    """(video_id, tag_idx, pop): tags of the items clicked in the window.

    An item needs a click in the window to be a candidate; the popularity
    join doubles as that restriction (before the explode, in both modes).
    """
    return join_small(pop.select("video_id", "pop"), items.long.select("video_id", "tag_idx"),
                      "video_id", size=items.long_size)


def score_items(selected: DataFrame, key: str, side: DataFrame) -> DataFrame:
    """(key, video_id, prob_sum, pop) for all items sharing a selected tag.

    ``prob_sum`` is the summed probability of the item's selected tags (a tag
    listed twice for an item counts twice, as in the reference).  The
    recommenders do not use this volume: see ``candidates.py``.
    """
    joined = selected.select(key, "tag_idx", "n", "total", "prob").join(side, "tag_idx")
    if is_integral(selected):
        agg = joined.groupBy(key, "video_id", "pop", "total").agg(F.sum("n").alias("_sn"))
        prob_sum = (F.col("_sn") / F.col("total")).alias("prob_sum")
    else:
        agg = joined.groupBy(key, "video_id", "pop").agg(F.sum("prob").alias("_sp"))
        prob_sum = F.col("_sp").alias("prob_sum")
    return agg.select(key, "video_id", prob_sum, "pop")


class Seen(NamedTuple):
    """A written seen history: every pair once, and the pairs per user."""

    pairs: DataFrame   # up_id, video_id
    counts: DataFrame  # up_id, w


def written_seen(pairs: DataFrame) -> Seen:
    """``Seen`` of a written table that holds every (up_id, video_id) once: the counts are written too.

    Whatever reads it shuffles the pairs at most once, by user, and never counts again.
    """
    pairs = pairs.select("up_id", "video_id")
    return Seen(pairs, cut_lineage(seen_counts(pairs, distinct=True), "seen-counts"))


def seen_by_user(seen: DataFrame | Seen) -> DataFrame:
    """Distinct (up_id, video_id) of the seen history, hash-partitioned by user.

    Pairs are de-duplicated first (map-side partial aggregation), so a user
    with a huge share of all events still brings at most one row per item
    into its partition (bounded by the catalogue, not by the event count).
    """
    pairs = seen.pairs if isinstance(seen, Seen) else seen.select("up_id", "video_id").distinct()
    return pairs.repartition("up_id")


def exclude_seen(cand: DataFrame, seen: DataFrame | Seen) -> DataFrame:
    """Drop (user, item) pairs present in ``seen`` (a left anti join)."""
    return cand.join(seen_by_user(seen), ["up_id", "video_id"], "left_anti")


def rank_order(source: Column | None = None) -> list[Column]:
    order = [F.col("prob_sum").desc(), F.col("pop").desc()]
    return ([source] if source is not None else []) + order


def rank_top_n(cand: DataFrame, n: int, key: str = "up_id", ties: str = "keep",
               limit_col: str | None = None) -> DataFrame:
    """Rank by (prob_sum desc, pop desc) within ``key``, keep rank <= n.

    ``ties='keep'`` uses ``rank()`` (a user may get more than n rows on a tie,
    as in the reference); ``'break'`` uses ``row_number()`` with ``video_id``
    as the last key.  The literal bound lets Spark insert a partial
    WindowGroupLimit before the sort.
    """
    if ties == "keep":
        fn, order = F.rank(), rank_order()
    elif ties == "break":
        fn, order = F.row_number(), rank_order() + [F.col("video_id")]
    else:
        raise ValueError(f"ties must be 'keep' or 'break', got {ties!r}")
    ranked = (cand.withColumn("rank", fn.over(Window.partitionBy(key).orderBy(*order)))
              .filter(F.col("rank") <= int(n)))
    if limit_col is not None:
        ranked = ranked.filter(F.col("rank") <= F.col(limit_col))
    return ranked


def best_items(selected: DataFrame, pop: DataFrame, items: ItemTags, k: int, n: int,
               seen: DataFrame | Seen | None = None, prior: DataFrame | None = None, ties: str = "keep") -> DataFrame:
    """(up_id, video_id, prob_sum, pop, rank, lim): each user's ``n`` best scored items.

    O13 (+O15 with ``seen``, +O16) in one: what ``score_items``,
    ``exclude_seen`` and ``rank_top_n`` give, without their volume.
    """
    pairs, counts = (None, None) if seen is None else (seen_by_user(seen), seen_counts(seen))
    cand = top_candidates(selected, k, n, item_postings(items, pop), "up_id", pairs, counts, prior)
    prob_sum = (F.col("score") / F.col("total")) if is_integral(selected) else F.col("score")
    return rank_top_n(cand.select("up_id", "video_id", prob_sum.alias("prob_sum"), "pop", "lim"),
                      n, ties=ties, limit_col="lim")


def user_recommendations(dist: DataFrame, pop: DataFrame, items: ItemTags, seen: DataFrame | Seen,
                         k: int, n: int, seed: int = 42, mode: str = "sample",
                         prior: DataFrame | None = None, ties: str = "keep") -> DataFrame:
    """(up_id, video_id, prob_sum, pop, rank, lim); see ``recommend_by_user``."""
    return best_items(select_tags(dist, "up_id", k, seed, mode), pop, items, k, n, seen, prior, ties)


def recommend_by_user(dist: DataFrame, pop: DataFrame, items: ItemTags, seen: DataFrame | Seen,
                      k: int, n: int, seed: int = 42, mode: str = "sample",
                      prior: DataFrame | None = None, ties: str = "keep") -> DataFrame:
    """(up_id, video_id, prob_sum, pop, rank) from per-user distributions.

    ``prior`` (up_id, n_prior) caps each user at ``n - n_prior`` rows and
    skips users already at n (the older-window fill of O19).
    """
    out = user_recommendations(dist, pop, items, seen, k, n, seed, mode, prior, ties)
    return out.select("up_id", "video_id", "prob_sum", "pop", "rank")


def seen_counts(seen: DataFrame | Seen, distinct: bool = False) -> DataFrame:
    """(up_id, w): distinct items each user has seen; with ``distinct`` the pairs of ``seen`` are known to be."""
    if isinstance(seen, Seen):
        return seen.counts
    pairs = seen if distinct else seen_by_user(seen)
    return pairs.groupBy("up_id").agg(F.count(F.lit(1)).alias("w"))


def label_candidates(label: str, dist: DataFrame, pop: DataFrame, items: ItemTags, k: int,
                     limits: DataFrame, seed: int = 42, mode: str = "sample") -> DataFrame:
    """(label, video_id, prob_sum, pop, label_rank) per label up to ``limits`` (label, lim).

    O17 first half.  The few labels travel to the item side, which stays
    spread; ranks come from counts per score, not from a sort of a label's list.
    """
    col = label_column(label)
    selected = select_tags(dist, col, k, seed, mode)
    cand = top_candidates(selected, k, 0, item_postings(items, pop), key=col, limits=limits)
    prob_sum = (F.col("score") / F.col("total")) if is_integral(selected) else F.col("score")
    cand = cut_lineage(cand.select(col, "video_id", prob_sum.alias("prob_sum"), "pop", "lim"), "label-candidates")
    return ranked_by_counts(cand, col, "lim", "label_rank").drop("lim")


def _label_people(label: str, profile: DataFrame, seen: DataFrame | Seen,
                  users: DataFrame | None) -> DataFrame:
    """(up_id, label, w[, lim]): profile rows carrying the label, with seen counts."""
    col = label_column(label)
    people = profile.select(F.col("id").alias("up_id"), col).filter(F.col(col).isNotNull())
    if users is not None:
        people = people.join(users.select("up_id", "lim"), "up_id")
    return (people.join(seen_counts(seen), "up_id", "left")
            .withColumn("w", F.coalesce(F.col("w"), F.lit(0)).cast("bigint")))


def label_cut(label: str, people: DataFrame, n: int) -> DataFrame:
    """(label, lim): ``n + max w(u)`` over the label's users -- the deepest
    label rank any of its users can still receive."""
    col = label_column(label)
    return people.groupBy(col).agg((F.max("w") + F.lit(int(n))).alias("lim"))


def label_depth(col: str, lists: Measured, people: DataFrame, seen: DataFrame | Seen, n: Column) -> DataFrame:
    """(up_id, label, depth): the deepest label rank that can reach each user's top ``n``.

    With a user's seen items of the list at ranks s1 <= s2 <= ..., the depth is
    ``n + i`` for the smallest i with ``s(i+1) > n + i``: of the first n + i
    rows at most i are seen, so n unseen ones beat whatever ranks below (ties
    included).  Seen items deeper than that cost the user nothing.  Users
    without a row here have depth ``n``.
    """
    asking = people.select("up_id", col, n.alias("_need")).distinct()
    met = join_small(seen_by_user(seen).join(asking, "up_id"), lists.table.select(col, "video_id", "label_rank"),
                     [col, "video_id"], size=lists.size)
    place = F.row_number().over(Window.partitionBy("up_id", col).orderBy("label_rank"))
    gap = F.when(F.col("label_rank") >= F.col("_need") + F.col("_at"), F.col("_at") - 1)
    return (met.withColumn("_at", place).groupBy("up_id", col)
            .agg((F.any_value("_need") + F.coalesce(F.min(gap), F.count(F.lit(1)))).alias("depth")))


def expand_label_to_users(label: str, cand: DataFrame, people: DataFrame, n: int, restricted: bool = False,
                          seen: DataFrame | Seen | None = None) -> DataFrame:
    """Label candidates -> (up_id, video_id, prob_sum, pop[, lim]) per user.

    Cut: if item x ends in user u's top n, at most n - 1 unseen items beat
    it, and at most w(u) seen ones, so its rank in u's label list is at most
    n + w(u) (exact, ties included).  With ``seen``, the seen items above the
    cut are counted instead (``label_depth``).  Lists are cut into rank buckets
    of powers of two and a user joins only the buckets up to its depth: a long
    history makes nobody read further than the items really seen up there.
    """
    col = label_column(label)
    lists = write_measured(cand.withColumn("bucket", bucket(F.col("label_rank"))), "label-lists")
    if seen is None:
        people = people.withColumn("depth", F.lit(int(n)) + F.col("w"))
    else:
        need = F.col("lim") if restricted else F.lit(int(n))
        depths = label_depth(col, lists, people, seen, need)
        people = (people.join(depths, ["up_id", col], "left")
                  .withColumn("depth", F.coalesce("depth", need)))
    asking = people.withColumn("bucket", F.explode(buckets_to(F.col("depth"))))
    fan = join_small(asking, lists.table, [col, "bucket"], size=lists.size,
                     condition=F.col("label_rank") <= F.col("depth"))
    extra = ["lim"] if restricted else []
    return fan.select("up_id", "video_id", "prob_sum", "pop", *extra)


def recommend_by_label(label: str, dist: DataFrame, pop: DataFrame, items: ItemTags,
                       profile: DataFrame, seen: DataFrame | Seen, k: int, n: int,
                       seed: int = 42, mode: str = "sample",
                       users: DataFrame | None = None, ties: str = "keep") -> DataFrame:
    """(up_id, video_id, prob_sum, pop, rank) from per-label distributions."""
    people = _label_people(label, profile, seen, users)
    cand = label_candidates(label, dist, pop, items, k, label_cut(label, people, n), seed, mode)
    per_user = expand_label_to_users(label, cand, people, n, users is not None, seen)
    ranked = rank_top_n(exclude_seen(per_user, seen), n, ties=ties,
                        limit_col="lim" if users is not None else None)
    return ranked.select("up_id", "video_id", "prob_sum", "pop", "rank")


def recommend_user_window(history: DataFrame, items: ItemTags, start, end, k: int, n: int,
                          seed: int = 42, mode: str = "sample", ties: str = "keep") -> DataFrame:
    """O18 over the events of ``[start, end]``: one scan gives interest, popularity and seen pairs."""
    pairs = cut_lineage(counted_pairs(history, c=(start, end)), "pairs")
    window = pairs_in(pairs, "c")
    return recommend_by_user(user_distribution_of(window, items), pair_popularity(window), items, written_seen(pairs),
                             k, n, seed, mode, ties=ties)


def recommend_label_window(label: str, profile: DataFrame, history: DataFrame, items: ItemTags, start, end,
                           k: int, n: int, seed: int = 42, mode: str = "sample", ties: str = "keep") -> DataFrame:
    """O17 over the events of ``[start, end]``, from one scan."""
    pairs = cut_lineage(counted_pairs(history, c=(start, end)), "pairs")
    window = pairs_in(pairs, "c")
    return recommend_by_label(label, label_distribution_of(label, profile, window, items),
                              pair_popularity(window), items, profile, written_seen(pairs), k, n, seed, mode,
                              ties=ties)


def _merge_windows(recent: DataFrame, older: DataFrame) -> DataFrame:
    """Recent rows first (own rank), older rows after them (n_recent + rank)."""
    head = recent.select("up_id", "video_id", F.col("rank").cast("int").alias("rank"),
                         F.lit(RECENT).alias("source"))
    tail = older.select("up_id", "video_id",
                        (F.col("rank") + F.col("n_recent")).cast("int").alias("rank"),
                        F.lit(OLDER).alias("source"))
    return head.unionByName(tail)


def _short_users(candidates: DataFrame, recent: DataFrame, n: int) -> DataFrame:
    """(up_id, lim, n_recent) for users with fewer than n recent rows."""
    counts = recent.groupBy("up_id").agg(F.count(F.lit(1)).alias("n_recent"))
    return (candidates.join(counts, "up_id", "left")
            .withColumn("n_recent", F.coalesce(F.col("n_recent"), F.lit(0)))
            .withColumn("lim", F.lit(int(n)) - F.col("n_recent"))
            .filter(F.col("lim") > 0))


def recommend_user_two_window(history: DataFrame, items: ItemTags, k: int, n: int,
                              to_date, window_days: int, seed: int = 42,
                              mode: str = "sample", seen: DataFrame | None = None,
                              ties: str = "keep") -> DataFrame:
    """(up_id, video_id, rank, source) -- recent interests, filled from all history.

    Recent list: distribution and popularity over ``[to_date - w, to_date]``.
    A user with fewer than n recent rows gets ``n - n_recent`` more from the
    whole history up to ``to_date`` (items already recommended excluded),
    ranked after the recent rows.  Users with a full recent list leave the
    whole-history pass before interests are counted; only its popularity is of
    all events.  The history is scanned once, into written counts per (user,
    item); the recent list (users x n rows) is written too, as it feeds the
    merge, the per-user counts and the exclusion.
    """
    to_date = as_date(to_date)
    pairs = _window_counts(history, to_date, window_days)
    new, old = pairs_in(pairs, "recent"), pairs_in(pairs, "older")
    seen = _seen_or(seen, pairs)
    recent = cut_lineage(recommend_by_user(user_distribution_of(new, items), pair_popularity(new), items, seen,
                                           k, n, seed, mode, ties=ties), "recent-user-list")
    prior = recent.groupBy("up_id").agg(F.count(F.lit(1)).alias("n_prior"))
    full = write_measured(prior.filter(F.col("n_prior") >= int(n)).select("up_id"), "full-users")
    asking = join_small(old, full.table, "up_id", "left_anti", size=full.size)
    seen_old = _seen_of(seen, recent, full, "left_anti")
    older = user_recommendations(user_distribution_of(asking, items), pair_popularity(old), items, seen_old,
                                 k, n, seed, mode, prior=prior, ties=ties)
    return _merge_windows(recent, older.withColumn("n_recent", F.lit(int(n)) - F.col("lim")))


def _seen_or(seen: DataFrame | None, pairs: DataFrame) -> Seen:
    """The given seen history, else the written counts per (user, item)."""
    return written_seen(pairs if seen is None else
                        cut_lineage(seen.select("up_id", "video_id").distinct(), "seen-pairs"))


def _seen_of(seen: Seen, recent: DataFrame, users: Measured, how: str) -> Seen:
    """Seen and already recommended pairs of the users that ``users`` keeps (``left_semi``) or leaves (``left_anti``).

    A recommended pair is an unseen one, so both parts together hold every pair once.
    """
    parts = [join_small(p.select("up_id", "video_id"), users.table.select("up_id"), "up_id", how, size=users.size)
             for p in (seen.pairs, recent)]
    return written_seen(cut_lineage(parts[0].unionByName(parts[1].distinct()), "seen-or-listed"))


def _window_counts(history: DataFrame, to_date, window_days: int) -> DataFrame:
    return cut_lineage(counted_pairs(history, recent=(days_before(to_date, window_days), to_date),
                                     older=(None, to_date)), "pairs")


def recommend_label_two_window(label: str, profile: DataFrame, history: DataFrame,
                               items: ItemTags, k: int, n: int, to_date, window_days: int,
                               seed: int = 42, mode: str = "sample",
                               seen: DataFrame | None = None,
                               ties: str = "keep") -> DataFrame:
    """The label twin of O19 (city or phone)."""
    to_date = as_date(to_date)
    pairs = _window_counts(history, to_date, window_days)
    new, old = pairs_in(pairs, "recent"), pairs_in(pairs, "older")
    seen = _seen_or(seen, pairs)
    recent = cut_lineage(recommend_by_label(
        label, label_distribution_of(label, profile, new, items), pair_popularity(new), items, profile,
        seen, k, n, seed, mode, ties=ties), "recent-label-list")
    col = label_column(label)
    people = (profile.filter(F.col(col).isNotNull())
              .select(F.col("id").alias("up_id")).distinct())
    written = write_measured(_short_users(people, recent, n), "short-users")
    short = written.table
    seen_old = _seen_of(seen, recent, written, "left_semi")
    older = recommend_by_label(
        label, label_distribution_of(label, profile, old, items), pair_popularity(old), items, profile,
        seen_old, k, n, seed, mode, users=short, ties=ties)
    older = older.join(short.select("up_id", "n_recent"), "up_id")
    return _merge_windows(recent, older)
