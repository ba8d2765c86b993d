"""Loaders for the three inputs (O1-O3) and the item-tag bundle.

Inputs may be DataFrames, table names or Parquet paths.  Only the columns the
operators use are selected, so Parquet scans prune to them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dates import date_column, in_range, string_range
from ..functions.joins import Size, write_measured
from ..operators import tags as tag_ops

LABEL_COLUMNS = {"city": "reside_city", "phone": "phone_type"}


def label_column(label: str) -> str:
    """``city`` -> ``reside_city``, ``phone`` -> ``phone_type``; others rejected."""
    if label in LABEL_COLUMNS.values():
        return label
    try:
        return LABEL_COLUMNS[label]
    except KeyError:
        raise ValueError(f"label must be one of {sorted(LABEL_COLUMNS)}, got {label!r}")


def _frame(spark: SparkSession | None, source) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if spark is None:
        spark = SparkSession.active()
    text = str(source)
    if "/" in text or text.endswith(".parquet"):
        return spark.read.parquet(text)
    return spark.table(text)


def present(df: DataFrame, name: str) -> Column:
    """Not NULL, and for strings not empty (a BIGINT is never compared to '')."""
    cond = F.col(name).isNotNull()
    if isinstance(df.schema[name].dataType, StringType):
        cond = cond & (F.col(name) != "")
    return cond


def load_profile(source, spark: SparkSession | None = None,
                 dedupe: bool = False) -> DataFrame:
    """O1: (id, reside_city, phone_type); no filtering, an empty label is a label.

    Duplicate profile rows multiply counts as in the reference (bag
    semantics); ``dedupe=True`` drops exact duplicates.
    """
    df = _frame(spark, source)
    cols = [F.col("id")]
    for name in ("reside_city", "phone_type"):
        cols.append(F.col(name) if name in df.columns
                    else F.lit(None).cast("string").alias(name))
    out = df.select(*cols)
    return out.dropDuplicates() if dedupe else out


def load_history(source, spark: SparkSession | None = None, start=None, end=None) -> DataFrame:
    """O2: (up_id, video_id, play_date DATE) without empty keys or dates.

    An event whose date cannot be read keeps its row with a NULL date: it is in
    no window but still counts as seen; ``undated_events`` counts such rows.
    ``start`` / ``end`` read only the events of a window: next to the exact
    filter, a range that Parquet can prune by is put on the raw column (for
    string dates a superset by year that holds for every accepted layout).
    """
    df = _frame(spark, source).select("up_id", "video_id", "play_date")
    kind = df.schema["play_date"].dataType
    out = df.filter(present(df, "up_id") & present(df, "video_id") & present(df, "play_date"))
    if isinstance(kind, StringType):
        out = out.filter(string_range(F.col("play_date"), start, end))
    out = out.select("up_id", "video_id", date_column(F.col("play_date"), kind).alias("play_date"))
    if start is None and end is None:
        return out
    return out.filter(in_range(F.col("play_date"), start, end))


def undated_events(history: DataFrame) -> DataFrame:
    """(n_events, n_undated): loaded events and those whose date could not be read."""
    return history.agg(F.count(F.lit(1)).alias("n_events"),
                       F.count_if(F.col("play_date").isNull()).alias("n_undated"))


@dataclass
class ItemTags:
    """The item -> tag table in every form the operators need.

    ``rows``        cleaned (video_id, video_second_class)
    ``dictionary``  (tag, tag_idx), at most ``n_tags`` rows (counted)
    ``long``        (video_id, tag, tag_idx), one row per tag per source row
    ``bags``        (video_id, tags, bag, mask, sig, path), one row per item
    ``signatures``  (sig, tags, bag, mask, path), one row per distinct bag
    ``n_tags``      the vector length D
    ``multiplicity`` the most times one tag is listed for one item

    ``dictionary``, ``long``, ``bags`` and ``signatures`` are tables written once
    per load, so the measured sizes belong to exactly the files that later plans
    read (``sig_size``: of the items' ids and signatures alone).
    """

    rows: DataFrame
    dictionary: DataFrame
    long: DataFrame
    bags: DataFrame
    signatures: DataFrame
    n_tags: int
    multiplicity: int
    long_size: Size = field(repr=False)
    sig_size: Size = field(repr=False)
    signature_size: Size = field(repr=False)

    def dense(self) -> DataFrame:
        return tag_ops.multi_hot(self.rows, self.dictionary, self.n_tags)


def load_item_tags(source, n_tags: int, spark: SparkSession | None = None,
                   dedupe: bool = False) -> ItemTags:
    """O3 (+O4, O6): clean the item -> CSV-tags table and index its vocabulary.

    Raises ``ValueError`` when the data holds more distinct tags than the
    vector length ``n_tags`` (the reference would index past its array).
    Repeated rows of an item count once each (bag semantics, as in the
    reference); ``dedupe=True`` drops exact duplicate rows first.
    """
    df = _frame(spark, source).select("video_id", "video_second_class")
    rows = df.filter(present(df, "video_second_class") & present(df, "video_id"))
    if dedupe:
        rows = rows.dropDuplicates()
    # a small file may be one scan task; the work per row below is spread over all
    rows = rows.hint("rebalance")
    vocabulary = write_measured(tag_ops.tag_tokens(rows).select("tag").distinct(), "vocabulary")
    if vocabulary.size.rows > n_tags:
        raise ValueError(f"more than n_tags={n_tags} distinct tags in the item table")
    dictionary = write_measured(tag_ops.tag_dictionary(vocabulary.table), "dictionary")
    long = write_measured(tag_ops.item_tags_long(rows, dictionary.table, dictionary.size), "item-tags")
    bags = write_measured(tag_ops.item_bags(long.table, n_tags), "item-bags", most=F.max(F.array_max("bag")),
                          ids=F.sum(F.octet_length("sig") + F.octet_length(F.col("video_id").cast("string")) + 48))
    signatures = write_measured(tag_ops.bag_signatures(bags.table), "signatures")
    return ItemTags(rows=rows, dictionary=dictionary.table, long=long.table, bags=bags.table,
                    signatures=signatures.table, n_tags=int(n_tags), multiplicity=bags.seen["most"] or 1,
                    long_size=long.size, sig_size=Size(bags.size.rows, bags.seen["ids"] or 0),
                    signature_size=signatures.size)


class Inputs(NamedTuple):
    profile: DataFrame
    history: DataFrame
    items: ItemTags


def load_inputs(profile, history, item_tags, n_tags: int,
                spark: SparkSession | None = None, dedupe: bool = False) -> Inputs:
    return Inputs(load_profile(profile, spark, dedupe), load_history(history, spark),
                  load_item_tags(item_tags, n_tags, spark, dedupe))
