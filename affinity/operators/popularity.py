"""Item popularity within a date window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_range


def popularity_of(counts: DataFrame) -> DataFrame:
    """(video_id, cnt, pop) from (video_id, cnt)."""
    total = counts.select(F.sum("cnt")).scalar()
    return counts.select("video_id", "cnt", (F.col("cnt") / total).alias("pop"))


def item_popularity(history: DataFrame, start=None, end=None) -> DataFrame:
    """(video_id, cnt, pop): clicks in ``[start, end]`` / all clicks in it.

    Every event counts (repeat watches too); the denominator includes clicks
    on untagged items.  The total is an uncorrelated scalar subquery over the
    same partial aggregate (its shuffle is reused), not a driver collect and
    not a join.
    """
    return popularity_of(history.filter(in_range(F.col("play_date"), start, end))
                         .groupBy("video_id").agg(F.count(F.lit(1)).alias("cnt")))


def pair_popularity(pairs: DataFrame) -> DataFrame:
    """(video_id, cnt, pop) from (up_id, video_id, c)."""
    return popularity_of(pairs.groupBy("video_id").agg(F.sum("c").alias("cnt")))
