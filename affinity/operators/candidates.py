"""Exact top-N candidate generation without the full key x item volume.

A key is a user or a label.  An item's score is ``sum(n(t) * times(t))`` over
the key's selected tags ``t`` in the item's bag.  One path serves every size
and both integer and DOUBLE counts:

* Inline scoring.  A key carries its at most k selected tags in the order
  (n desc, tag asc); an item carries its bag and its tag set as bits.  A pair
  is kept at the first selected tag that the item has (one bit test per word
  against the key's earlier tags) and scored on that row by k look-ups that
  whole-stage codegen compiles.  The sum always runs in the key's tag order, so
  a pair has the same score, to the last bit, wherever it is generated.

* Score floor.  A probe scores the ``lim + w`` most popular items of each
  selected tag (``w`` = items the key has seen), drops seen pairs and takes the
  lim-th best score theta.  The true lim-th best unseen score is at least
  theta, so only pairs scoring >= theta can rank <= lim.  Postings are cut into
  rank buckets of powers of two, and a key reads only the buckets that its own
  depth needs: the probe is linear in list lengths plus seen pairs.  Places that
  no key asks for are in no posting.

* Signatures.  Items with the same bag score the same for every key, so the
  second pass scores (key, signature) pairs, starts only from tags whose
  suffix mass can still reach theta, and expands only signatures at or above
  the floor to their items.

* Blocks.  A tag's signatures are cut into blocks by the most common other
  tag that they hold, and those by the second.  A block knows the union of its
  signatures' tags and their largest multiplicity, hence the most that any of
  them can score for a key: whole blocks below theta are skipped, level by
  level, and only what is left is scored.  Of a user's scored signatures, only
  the best that hold ``lim + w`` items (ties included) go on, and of their
  classes (the items of one signature and popularity) again only the best that
  hold as many: no more is expanded to items.

Ranks (ties included) are exactly those of ranking every candidate: every pair
that beats a pair of rank <= lim scores at least theta as well.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..functions.joins import Measured, Size, fits, join_small, measure, within_plan, write_measured
from ..sources.inputs import ItemTags
from .tags import mask_words, tag_mask

# Doubles: how much a suffix sum in another order may fall short of the score.
ROUNDING = 1e-9
# Items of one tag and popularity that one task numbers, on average.
TIE_ROWS = 65_536
# Users that one task generates candidates for, on average.
TASK_KEYS = 4_000
# Levels of blocks: how many common tags a block's signatures share (at most ``tags.PATH - 1``).
LEVELS = (1, 2)
# Path entry of a signature that holds no further tag.
NO_TAG = -1


def bucket(rank: Column) -> Column:
    """Power-of-two bucket of a rank from 1: 0 holds rank 1, b holds [2^b, 2^(b+1))."""
    return F.floor(F.log2(rank)).cast("int")


def buckets_to(depth: Column) -> Column:
    """All buckets that hold a rank up to ``depth`` (at least 1)."""
    return F.sequence(F.lit(0), bucket(F.greatest(depth, F.lit(1))))


class Postings(NamedTuple):
    """The items clicked in a window, by signature, by popularity and by item.

    A class holds the items of one signature and popularity: for any key they
    score and rank alike.  Every table has the size that its joins go by.
    """

    blocks: list[DataFrame]   # per level: tag_idx, b1 .., _union, _most
    block_sizes: list[Size]
    signatures: DataFrame     # tag_idx, b1 .., sig, n_items, bag, mask
    signature_size: Size
    classes: DataFrame        # sig, pop, n_items
    class_size: Size
    items: DataFrame          # sig, pop, video_id
    item_size: Size
    multiplicity: int
    n_tags: int


def item_postings(items: ItemTags, pop: DataFrame) -> Postings:
    """Postings of the items in ``pop`` (video_id, pop); the join restricts to clicked items."""
    side = write_measured(join_small(pop.select("video_id", "pop"), items.bags.select("video_id", "sig"), "video_id",
                                     size=items.sig_size), "item-side")
    classes = write_measured(side.table.groupBy("sig", "pop").agg(F.count(F.lit(1)).alias("n_items")), "item-classes")
    distinct = join_small(classes.table.groupBy("sig").agg(F.sum("n_items").alias("n_items")), items.signatures,
                          "sig", size=items.signature_size)
    written = write_measured(
        _along_paths(distinct.select("sig", "n_items", "bag", "mask", "path", F.explode("tags").alias("tag_idx")))
        .select("tag_idx", *_steps(LEVELS[-1]), "sig", "n_items", "bag", "mask"), "item-signatures")
    signatures = written.table
    blocks = [_blocks(signatures, level, items.n_tags) for level in LEVELS]
    # blocks are no more and no wider than their signatures: where all may be broadcast, that is known enough
    bound = Size(written.size.rows, (1 + len(blocks)) * written.size.bytes)
    sizes = [written.size if fits(signatures, bound) else measure(b) for b in blocks]
    return Postings(blocks, sizes, signatures, written.size, classes.table, classes.size,
                    side.table, side.size, items.multiplicity, items.n_tags)


def popular_postings(postings: Postings, deepest: int) -> Measured:
    """(tag_idx, bucket, prank, video_id, bag, mask): each tag's items up to place ``deepest`` by popularity.

    What no probe reads is left out before anything is sorted, so the table
    grows with the depth that is asked for, not with the catalogue.
    """
    of_sig = postings.signatures.select("sig", "tag_idx")
    posting = join_small(postings.items, of_sig, "sig", size=postings.signature_size)
    counts = (join_small(postings.classes, of_sig, "sig", size=postings.signature_size)
              .groupBy("tag_idx", "pop").agg(F.sum("n_items").alias("_n")))
    ranked = popularity_ranks(posting, counts, deepest).filter(F.col("prank") <= int(deepest))
    bags = postings.signatures.select("sig", "tag_idx", "bag", "mask")
    return write_measured(
        join_small(ranked, bags, ["sig", "tag_idx"], size=postings.signature_size)
        .select("tag_idx", bucket(F.col("prank")).alias("bucket"), "prank", "video_id", "bag", "mask"), "popular-items")


def popularity_ranks(posting: DataFrame, counts: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """``posting`` with ``prank``, the place of an item among its tag's items by popularity.

    Numbers never come from one sort of a whole tag.  Items of one (tag, pop)
    start after all more popular ones, which running sums over a tag's distinct
    popularities tell (with E events there are at most sqrt(2 E) of them).
    Within, items are numbered in hashed order by ``_parts`` of about
    ``TIE_ROWS`` rows side by side: place ``k`` of part ``p`` comes
    ``(k - 1) * parts + p``-th.  With one part the numbers are 1, 2, 3, ...; with
    more they may leave or share a few places, which is all the same to a
    probe that only wants about the first so many.

    ``counts`` (tag_idx, pop, _n) are the items per tag and popularity, where
    known; with ``deepest``, popularities that begin below that place are left out.
    """
    better = Window.partitionBy("tag_idx").orderBy(F.col("pop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    if counts is None:
        counts = posting.groupBy("tag_idx", "pop").agg(F.count(F.lit(1)).alias("_n"))
    groups = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(better), F.lit(0)))
              .withColumn("_parts", F.ceil(F.col("_n") / TIE_ROWS)).drop("_n"))
    if deepest is not None:
        groups = groups.filter(F.col("_before") < int(deepest))
    part = F.pmod(F.xxhash64("video_id"), F.col("_parts"))
    order = F.xxhash64(F.lit(1), F.col("video_id"))
    place = F.row_number().over(Window.partitionBy("tag_idx", "pop", "_part").orderBy(order, "video_id"))
    return (posting.join(groups, ["tag_idx", "pop"]).withColumn("_part", part)
            .withColumn("prank", F.col("_before") + (place - 1) * F.col("_parts") + F.col("_part") + 1)
            .drop("_before", "_parts", "_part"))


def _steps(level: int) -> list[str]:
    return [f"b{i + 1}" for i in range(level)]


def _along_paths(signatures: DataFrame) -> DataFrame:
    """Signature postings with b1, b2, ...: the most common tags of the signature next to the posting's own."""
    others = F.filter("path", lambda t: t != F.col("tag_idx"))
    return signatures.select("tag_idx", "sig", "n_items", "bag", "mask", *[
        F.coalesce(F.get(others, i), F.lit(NO_TAG)).alias(b) for i, b in enumerate(_steps(LEVELS[-1]))])


def _blocks(signatures: DataFrame, level: int, n_tags: int) -> DataFrame:
    """(tag_idx, b1 .., _union, _most): the tags in a block as bits and the largest multiplicity in it."""
    union = F.array(*[F.bit_or(F.get("mask", w)) for w in range(mask_words(n_tags))])
    return signatures.groupBy("tag_idx", *_steps(level)).agg(union.alias("_union"), F.max(F.array_max("bag")).alias("_most"))


def is_integral(selected: DataFrame) -> bool:
    return not isinstance(selected.schema["n"].dataType, (DoubleType, FloatType, DecimalType))


def key_tags(selected: DataFrame, key: str) -> DataFrame:
    """(key, _t ARRAY<tag_idx>, _n ARRAY<n>, total): the key's tags by (n desc, tag asc)."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "tag_idx")))
    return selected.groupBy(key).agg(ordered.alias("_s"), F.max("total").alias("total")).select(
        key, F.transform("_s", lambda s: s["tag_idx"]).alias("_t"),
        F.transform("_s", lambda s: -s["neg"]).alias("_n"), "total")


def _starts(info: DataFrame, key: str, k: int, n_tags: int) -> DataFrame:
    """One row per key and start tag ``tag_idx`` (position ``_i``).

    The key's tags and counts are plain columns ``_t0.. / _n0..`` (k is a
    parameter), ``_before`` holds the tags ahead of the start as bits and
    ``_rest`` the count mass from the start on.
    """
    zero = F.lit(0).cast("bigint") if is_integral(info.select(F.element_at("_n", 1).alias("n"))) else F.lit(0.0)
    rows = info.select("*", F.posexplode("_t").alias("_i", "tag_idx"))
    plain = [F.get(c, j).alias(f"{c}{j}") for c in ("_t", "_n") for j in range(int(k))]
    rest = F.aggregate(F.slice("_n", F.col("_i") + 1, F.size("_n")), zero, lambda a, x: a + x)
    rests = F.slice(F.arrays_zip(F.col("_t").alias("t"), F.col("_n").alias("n")), F.col("_i") + 1, F.size("_t"))
    return rows.select(key, "total", "lim", "w", "_i", "tag_idx", *plain, rest.alias("_rest"), rests.alias("_rests"),
                       tag_mask(F.slice("_t", F.lit(1), F.col("_i")), n_tags).alias("_before"))


def _scored(pairs: DataFrame, k: int, n_tags: int, integral: bool) -> DataFrame:
    """Pairs kept at their first selected tag, with ``score``."""
    met = F.lit(0).cast("bigint")
    for w in range(mask_words(n_tags)):
        met = met.bitwiseOR(F.get("mask", w).bitwiseAND(F.get("_before", w)))
    zero = F.lit(0).cast("bigint") if integral else F.lit(0.0)
    score = zero
    for j in range(int(k)):
        score = score + F.coalesce(F.col(f"_n{j}") * F.get("bag", F.col(f"_t{j}")), zero)
    return pairs.filter(met == 0).withColumn("score", score)


def _at_most(integral: bool) -> Column:
    """The most that a signature of a block can score from the key's start tag on.

    A loop over ``_rests`` on purpose: unrolled like the score, the tests of all
    levels would share one generated method too long for the JIT compiler.
    """
    def held(tag: Column) -> Column:
        return F.getbit(F.get("_union", F.shiftright(tag, 6)), tag.bitwiseAND(F.lit(63))) == 1

    zero = F.lit(0).cast("bigint") if integral else F.lit(0.0)
    mass = F.aggregate("_rests", zero, lambda a, s: a + F.when(held(s["t"]), s["n"]).otherwise(zero)) * F.col("_most")
    return mass if integral else mass * F.lit(1 + ROUNDING)


def _meet(keys: DataFrame, key_size: Size | None, side: DataFrame, side_size: Size | None, on: list[str]) -> DataFrame:
    """Keys joined to postings: the smaller measured side is broadcast if it may be (a ``side`` without a size may not).

    A few labels travel to the item side, which stays spread; many users keep
    their place and the item side travels; two large sides are shuffled.
    """
    if key_size is not None and fits(keys, key_size) and (side_size is None or key_size.bytes < side_size.bytes):
        return side.join(F.broadcast(keys), on)
    return join_small(keys, side, on, size=side_size)


def top_candidates(selected: DataFrame, k: int, n: int, postings: Postings, key: str = "up_id",
                   seen_pairs: DataFrame | None = None, seen_counts: DataFrame | None = None,
                   prior: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """(key, video_id, score, total, pop, lim): (unseen) pairs that can rank <= lim.

    ``selected`` (key, tag_idx, n, total) -- at most ``k`` drawn tags of each key;
    ``limits`` (key, lim) -- list length per key (keys without one are skipped);
    otherwise ``prior`` (key, n_prior) gives ``lim = n - n_prior`` (keys with
    ``lim <= 0`` are skipped), and without either ``lim = n``;
    ``seen_pairs`` (up_id, video_id), ``seen_counts`` (up_id, w) -- items that a
    user's list leaves out; label lists pass neither.
    """
    integral = is_integral(selected)
    info = key_tags(selected, key).filter(F.col(key).isNotNull())
    if limits is not None:
        info = info.join(limits.select(key, F.col("lim").cast("bigint").alias("lim")), key)
    elif prior is None:
        info = info.withColumn("lim", F.lit(int(n)).cast("bigint"))
    else:
        info = (info.join(prior.select(key, "n_prior"), key, "left")
                .withColumn("lim", (F.lit(int(n)) - F.coalesce("n_prior", F.lit(0))).cast("bigint"))
                .filter(F.col("lim") > 0).drop("n_prior"))
    if seen_counts is not None:
        info = (info.join(seen_counts, key, "left")
                .withColumn("w", F.coalesce("w", F.lit(0)).cast("bigint")))
    else:
        info = info.withColumn("w", F.lit(0).cast("bigint"))
    per_label = key != "up_id"
    depth = F.col("lim") + F.col("w")
    written = write_measured(info, "key-tags", deepest=F.max(depth))
    info, key_size = written.table, written.size if per_label else None
    popular = popular_postings(postings, written.seen["deepest"] or 1)
    if not per_label:
        # candidates then stay where their user is; the number is given, as AQE would
        # merge these few bytes into one partition and with it all that they generate
        least = int(info.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        info = info.repartition(max(least, -(-written.size.rows // TASK_KEYS)), key)
    starts = _starts(info, key, k, postings.n_tags)
    # all six sides are in one plan: what each key meets most often goes first
    signature_size, *block_sizes, popular_size, class_size, item_size = within_plan(info, [
        postings.signature_size, *reversed(postings.block_sizes), popular.size, postings.class_size, postings.item_size])

    def unseen(df: DataFrame) -> DataFrame:
        return df if seen_pairs is None else df.join(seen_pairs, ["up_id", "video_id"], "left_anti")

    # pass 1: score floor from the most popular items of each selected tag
    wanted = starts.withColumn("bucket", F.explode(buckets_to(depth)))
    probe = _meet(wanted, key_size, popular.table, popular_size, ["tag_idx", "bucket"])
    probe = unseen(_scored(probe.filter(F.col("prank") <= depth), k, postings.n_tags, integral)
                   .select(key, "video_id", "score", "lim"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc())
    floor = (probe.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") == F.col("lim"))
             .select(key, F.col("score").alias("theta")))
    # pass 2: start from tag i only if it and the tags after it can still reach theta
    reach = F.col("_rest") * F.lit(postings.multiplicity)
    if not integral:
        reach = reach * F.lit(1 + ROUNDING)
    theta = F.coalesce("theta", F.lit(0).cast("bigint") if integral else F.lit(0.0))
    rows = (starts.join(floor, key, "left").withColumn("theta", theta)
            .filter(reach >= F.col("theta")))
    # whole blocks of signatures below theta go first
    for level, blocks, size in zip(LEVELS, postings.blocks, reversed(block_sizes)):
        on = ["tag_idx", *_steps(level)]
        met = (_meet(rows, key_size, blocks, size, ["tag_idx"]) if level == LEVELS[0]
               else join_small(rows, blocks, on[:1 + LEVELS[LEVELS.index(level) - 1]], size=size))
        rows = met.filter(_at_most(integral) >= F.col("theta")).drop("_union", "_most")
    by_sig = _scored(join_small(rows, postings.signatures, ["tag_idx", *_steps(LEVELS[-1])],
                                size=signature_size), k, postings.n_tags, integral)
    by_sig = by_sig.filter(F.col("score") >= F.col("theta")).select(key, "sig", "n_items", "score", "total", "lim", "w")
    if per_label:
        cand = join_small(by_sig, postings.items, "sig", size=item_size)
    else:
        by_class = join_small(_within_reach(by_sig, key, "score").drop("n_items"), postings.classes, "sig",
                              size=class_size)
        cand = join_small(_within_reach(by_class, key, "score", "pop"), postings.items, ["sig", "pop"],
                          size=item_size)
    return unseen(cand.select(key, "video_id", "score", "total", "pop", "lim"))


def _within_reach(groups: DataFrame, key: str, *by: str) -> DataFrame:
    """The (key, signature) or (key, class) rows that can still rank <= lim, where the rows of a key lie together.

    Where rows of rank value ``by`` and better hold ``lim + w`` items, at least
    ``lim`` of them are unseen, and whatever comes below ranks below them.
    """
    so_far = F.sum("n_items").over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in by])
                                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = F.struct(*by)
    enough = F.when(F.col("_so_far") >= F.col("lim") + F.col("w"), value)
    return (groups.withColumn("_so_far", so_far)
            .withColumn("_least", F.max(enough).over(Window.partitionBy(key)))
            .filter(F.col("_least").isNull() | (value >= F.col("_least"))).drop("_so_far", "_least"))


def ranked_by_counts(cand: DataFrame, key: str, limit: str, rank: str) -> DataFrame:
    """``rank()`` per key by (prob_sum desc, pop desc) up to the column ``limit``, without sorting a key's rows.

    Rows are counted per (key, prob_sum); running sums over a key's distinct
    scores find those that begin within the limit.  What is left is counted per
    (key, prob_sum, pop); running sums over the distinct popularities of one
    score give every rank, and the rows take theirs by a join.  A window holds
    distinct values only, and of the last score no more than its own.  ``cand``
    is read three times: a written table.
    """
    def before(*by: str) -> Column:
        window = Window.partitionBy(key, *by[:-1]).orderBy(F.col(by[-1]).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    count = F.count(F.lit(1)).alias("_n")
    scores = (cand.groupBy(key, "prob_sum").agg(count, F.max(limit).alias("_lim"))
              .withColumn("_above", before("prob_sum")).filter(F.col("_above") < F.col("_lim")).drop("_n", "_lim"))
    ranks = (cand.join(scores, [key, "prob_sum"]).groupBy(key, "prob_sum", "pop", "_above", limit).agg(count)
             .withColumn(rank, F.col("_above") + before("prob_sum", "pop") + 1)
             .filter(F.col(rank) <= F.col(limit)))
    return cand.join(ranks.select(key, "prob_sum", "pop", rank), [key, "prob_sum", "pop"])
