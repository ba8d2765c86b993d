"""Item tags: tokens, dictionary, long form, bags and multi-hot view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import Size, join_small

TAG_SEPARATOR = ","
# Tags of an item that its blocks are cut along, next to the tag whose postings they are in.
PATH = 3


def slots(entries: Column, n_slots: int, zero: Column) -> Column:
    """ARRAY of ``n_slots`` values from ARRAY<STRUCT<at, value>> sorted by ``at`` (distinct), ``zero`` elsewhere.

    Laid out run by run between the entries: the cost of a slot is a copy, not
    a look-up in a map that the optimizer may rebuild for every slot.
    """
    inside = F.filter(entries, lambda e: e["at"] < int(n_slots))
    at = F.transform(inside, lambda e: e["at"])
    before = F.concat(F.array(F.lit(-1)), at)
    runs = F.transform(inside, lambda e, i: F.concat(
        F.array_repeat(zero, e["at"] - F.get(before, i) - 1), F.array(F.coalesce(e["value"], zero))))
    last = F.element_at(before, -1)
    return F.concat(F.flatten(runs), F.array_repeat(zero, F.lit(int(n_slots) - 1) - last))


def tag_tokens(rows: DataFrame, csv_col: str = "video_second_class") -> DataFrame:
    """One row per distinct non-empty token of each tag-table row.

    Repeated tokens within a row count once (set per row); rows repeating a
    ``video_id`` are kept apart (bag per item), as in the multi-hot encoding.
    Empty tokens (``",a"``, ``"a,"``, ``"a,,b"``) are dropped.
    """
    return rows.select("video_id", F.explode(_token_set(csv_col)).alias("tag"))


def _token_set(csv_col: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.col(csv_col), TAG_SEPARATOR),
                                     lambda t: t != ""))


def tag_dictionary(vocabulary: DataFrame) -> DataFrame:
    """(tag, tag_idx): dense 0-based index in lexicographic (binary) order.

    ``vocabulary`` must hold distinct tags and be counted (at most the vector
    length D, checked by the loader): the single ordered window below runs in
    one task.
    """
    order = Window.orderBy("tag")
    return vocabulary.select(
        "tag", (F.row_number().over(order) - 1).cast("int").alias("tag_idx"))


def item_tags_long(rows: DataFrame, dictionary: DataFrame, size: Size) -> DataFrame:
    """(video_id, tag, tag_idx): the multi-hot table in long form.

    The dictionary holds at most D rows, so the item table is not shuffled.
    """
    return join_small(tag_tokens(rows), dictionary, "tag", size=size)


def item_bags(long: DataFrame, n_tags: int) -> DataFrame:
    """(video_id, tags, bag, mask, sig, path): each item's tags, in the forms that scoring reads.

    ``tags`` ARRAY<INT> lists the tag indexes; ``bag`` ARRAY<INT> has each
    tag's multiplicity in a slot per index (length D, a parameter), so that a
    look-up takes constant time; ``mask`` ARRAY<BIGINT> is the tag set in
    64-bit words; ``sig`` spells the bag out: items with the same bag score
    the same for every user.  ``path`` has the item's ``PATH`` most common
    tags, the most common first: blocks of signatures are cut along it.
    """
    times = long.groupBy("video_id", "tag_idx").agg(F.count(F.lit(1)).alias("times"))
    entries = times.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.struct("tag_idx", F.col("times").cast("int").alias("times")))).alias("e"))
    sig = F.array_join(F.transform("e", lambda x: F.concat_ws(
        ":", x["tag_idx"].cast("string"), x["times"].cast("string"))), ",")
    bag = slots(F.transform("e", lambda x: F.struct(x["tag_idx"].alias("at"), x["times"].alias("value"))),
                n_tags, F.lit(0))
    tags = F.transform("e", lambda x: x["tag_idx"])
    # items per tag as one array value of length D
    common = times.groupBy("tag_idx").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("tag_idx", "n"))).alias("m")).select("m").scalar()
    path = F.slice(F.array_sort(F.transform("e", lambda x: F.struct(
        (-F.try_element_at("_common", x["tag_idx"])).alias("n"), x["tag_idx"].alias("t")))), 1, PATH)
    return entries.withColumn("_common", common).select(
        "video_id", tags.alias("tags"), bag.alias("bag"), tag_mask(tags, n_tags).alias("mask"), sig.alias("sig"),
        F.transform(path, lambda x: x["t"]).alias("path"))


def bag_signatures(bags: DataFrame) -> DataFrame:
    """(sig, tags, bag, mask, path): the distinct bags."""
    return bags.groupBy("sig").agg(*[F.any_value(c).alias(c) for c in ("tags", "bag", "mask", "path")])


def mask_words(n_tags: int) -> int:
    return -(-int(n_tags) // 64)


def tag_mask(tags: Column, n_tags: int) -> Column:
    """ARRAY<BIGINT>: the set of tag indexes as bits, 64 to a word."""
    zero = F.lit(0).cast("bigint")

    def word(w: int) -> Column:
        return F.aggregate(tags, zero, lambda a, t: F.when(
            F.shiftright(t, 6) == w, a.bitwiseOR(F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63))))).otherwise(a))
    return F.array(*[word(w) for w in range(mask_words(n_tags))])


def multi_hot(rows: DataFrame, dictionary: DataFrame, n_tags: int) -> DataFrame:
    """(video_id, tags ARRAY<TINYINT>) of length D, one row per tag-table row.

    Map-side: the dictionary (at most D tags) is one array value in which
    each of the row's tokens finds its place.
    """
    words = dictionary.agg(F.transform(F.sort_array(F.collect_list(F.struct("tag_idx", "tag"))),
                                       lambda e: e["tag"])).scalar()
    tokens = rows.select("video_id", _token_set("video_second_class").alias("_tokens"))
    at = F.transform("_tokens", lambda t: (F.array_position("_words", t) - 1).cast("int"))
    places = F.array_sort(F.filter(at, lambda i: i >= 0))
    vector = slots(F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(1).cast("tinyint").alias("value"))),
                   n_tags, F.lit(0).cast("tinyint"))
    return (tokens.filter(F.size("_tokens") > 0).withColumn("_words", words)
            .select("video_id", vector.alias("tags")))


def tag_index_list(dense: DataFrame, tags_col: str = "tags") -> DataFrame:
    """Multi-hot vector -> one row per set position (video_id, tag_idx).

    The outer form, as the plain one makes the optimizer test the vector's size
    first and build it once more for that; ``_v > 0`` drops what it adds.
    """
    return (dense.select("video_id", F.posexplode_outer(tags_col).alias("tag_idx", "_v"))
            .filter(F.col("_v") > 0)
            .select("video_id", F.col("tag_idx").cast("int").alias("tag_idx")))
