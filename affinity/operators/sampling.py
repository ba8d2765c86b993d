"""Drawing k tags per key from its distribution (O11) or taking the top k.

Sampling is a filter over each key's entries: no UDF, no join, no driver state.  For each key the tags are laid out on ``[0, total)`` in
tag-index order (``hi`` = running count); draw ``j`` selects the tag whose
interval ``[hi - n, hi)`` contains ``u_j * total`` with
``u_j = draw_hash(seed, key, j) / 2**32``.  A tag drawn several times is kept
once (so at most k tags, often fewer), zero-probability tags can never be
drawn, and the same seed gives the same tags on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..functions.hashing import DRAW_RANGE, draws


def _running(key: str) -> Window:
    return (Window.partitionBy(key).orderBy("tag_idx")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _position(h: Column, total: Column) -> Column:
    """floor(h * total / 2**32) for h < 2**32 in BIGINT, without overflow.

    ``total`` is split at bit 32 and ``h`` at bit 16, so that no product
    exceeds 63 bits.
    """
    high, low = F.shiftright(total, 32), total.bitwiseAND(F.lit(DRAW_RANGE - 1))
    a, b = F.shiftright(h, 16), h.bitwiseAND(F.lit(0xFFFF))
    return h * high + F.shiftright(a * low + F.shiftright(b * low, 16), 16)


def sample_tags(dist: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The distinct tags hit by k seeded inverse-CDF draws per key.

    Keeps the distribution's columns ``(key, tag_idx, n, total, prob)``.  The k
    draws are hashed once per key, on its first row, turned into positions on
    [0, total) and handed to the key's other rows (at most D) by a window over
    the partitioning and order that the distribution already has.  Counts are
    compared exactly in BIGINT, a DOUBLE distribution given as a vector in
    DOUBLE.
    """
    if k <= 0:
        return dist.limit(0)
    exact = not isinstance(dist.schema["n"].dataType, (DoubleType, FloatType, DecimalType))
    total = F.col("total")
    at = F.transform(draws(seed, F.col(key), k), lambda h: _position(h, total) if exact
                     else h * total / F.lit(float(DRAW_RANGE)))
    rows = (dist.withColumn("_hi", F.sum("n").over(_running(key)))
            .withColumn("_first", F.row_number().over(_running(key))))
    rows = (rows.withColumn("_at", F.when(F.col("_first") == 1, at))
            .withColumn("_at", F.first("_at").over(_running(key))))
    hit = F.lit(False)
    for j in range(int(k)):
        p = F.get("_at", j)
        hit = hit | ((p >= F.col("_hi") - F.col("n")) & (p < F.col("_hi")))
    return rows.filter(hit).drop("_hi", "_first", "_at")


def top_tags(dist: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent tags per key (ties broken by tag index)."""
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("tag_idx"))
    return (dist.withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") <= int(k)).drop("_rn"))


def select_tags(dist: DataFrame, key: str, k: int, seed: int = 42,
                mode: str = "sample") -> DataFrame:
    if mode == "sample":
        return sample_tags(dist, key, k, seed)
    if mode == "top":
        return top_tags(dist, key, k)
    raise ValueError(f"mode must be 'sample' or 'top', got {mode!r}")
