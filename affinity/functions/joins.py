"""Joins that broadcast only what is measured to be small.

``write_measured`` writes an intermediate and observes, in that same job, its
rows, the bytes of its values and other aggregates; ``measure`` does so for a
table that exists.  ``join_small`` broadcasts a side whose measured size is
below both caps; ``within_plan`` bounds what the sides of one plan take together.
Beyond them it is a plain shuffle join: AQE splits its large partitions, so a
key with few values or one hot value still spreads, and no side is copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, ByteType, DataType, IntegerType, MapType, StringType,
                               StructType)

from ..session import cut_lineage

# The driver holds a broadcast side about four times over (hashed, which doubles
# it, and again in blocks), and a plan may hold several at once: those that a plan
# chooses together share PLAN_SIDES times the bytes of one (``within_plan``), which
# fits a heap of 750 MB.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 32 << 20
PLAN_SIDES = 2
ROWS_CONF = "spark.affinity.broadcastMaxRows"
BYTES_CONF = "spark.affinity.broadcastMaxBytes"


class Size(NamedTuple):
    rows: int
    bytes: int


def _bytes_of(col: Column, kind: DataType) -> Column:
    """Bytes of a value in memory, from its actual length (nested values included)."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return _sum_over(col, kind.elementType) + 32
    if isinstance(kind, MapType):
        return _sum_over(F.map_keys(col), kind.keyType) + _sum_over(F.map_values(col), kind.valueType) + 64
    if isinstance(kind, StructType):
        return sum((_bytes_of(col[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def _sum_over(array: Column, kind: DataType) -> Column:
    if not isinstance(kind, (StringType, BinaryType, ArrayType, MapType, StructType)):
        width = 1 if isinstance(kind, ByteType) else 4 if isinstance(kind, IntegerType) else 8
        return F.greatest(F.size(array), F.lit(0)) * width
    return F.coalesce(F.aggregate(array, F.lit(0).cast("bigint"),
                                  lambda total, x: total + _bytes_of(x, kind).cast("bigint")), F.lit(0).cast("bigint"))


def _sizes(df: DataFrame, copies: Column | None) -> list[Column]:
    copies = F.lit(1) if copies is None else copies
    width = sum((_bytes_of(F.col(f.name), f.dataType) for f in df.schema), F.lit(16))
    return [F.sum(copies.cast("bigint")).alias("n"), F.sum(width.cast("bigint") * copies).alias("b")]


def measure(df: DataFrame, copies: Column | None = None) -> Size:
    """Rows and bytes of a frame: one aggregation job, meant for written tables.

    With ``copies``, of the frame in which each row stands that many times.
    """
    got = df.agg(*_sizes(df, copies)).first()
    return Size(got["n"] or 0, got["b"] or 0)


class Measured(NamedTuple):
    """A written table with what was observed while it was written."""

    table: DataFrame
    size: Size
    seen: dict


def write_measured(df: DataFrame, name: str, copies: Column | None = None, **aggregates: Column) -> Measured:
    """``cut_lineage`` that also measures: no job beyond the write itself.

    ``copies`` as in ``measure``; ``aggregates`` are further values to observe
    (NULL for a frame without rows).
    """
    note = Observation(name)
    noted = df.observe(note, *_sizes(df, copies), *[c.alias(k) for k, c in aggregates.items()])
    table = cut_lineage(noted, name)
    got = note.get  # empty where the optimizer knows that there is no row
    return Measured(table, Size(got.get("n") or 0, got.get("b") or 0), {k: got.get(k) for k in aggregates})


def fits(df: DataFrame, size: Size | None) -> bool:
    """True if a measured size may be broadcast (caps are session settings)."""
    conf = df.sparkSession.conf
    return (size is not None and size.rows <= int(conf.get(ROWS_CONF, str(BROADCAST_MAX_ROWS)))
            and size.bytes <= int(conf.get(BYTES_CONF, str(BROADCAST_MAX_BYTES))))


def within_plan(df: DataFrame, sizes: Sequence[Size | None]) -> list[Size | None]:
    """The sizes of the sides that one plan may broadcast together, the first ones first; None for the others."""
    left, kept = PLAN_SIDES * int(df.sparkSession.conf.get(BYTES_CONF, str(BROADCAST_MAX_BYTES))), []
    for size in sizes:
        taken = fits(df, size) and size.bytes <= left
        left -= size.bytes if taken else 0
        kept.append(size if taken else None)
    return kept


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner", *,
               size: Size | None, condition: Column | None = None) -> DataFrame:
    """Join ``big`` to ``small``, broadcast if its measured ``size`` is below the caps.

    A broadcast leaves ``big`` where it is.  ``condition`` is an extra
    (non-equi) predicate over columns of both sides; the column names it
    refers to must be unique across the two frames.
    """
    keys = [on] if isinstance(on, str) else list(on)
    right = F.broadcast(small) if fits(big, size) else small
    out = big.join(right, keys, how)
    return out if condition is None else out.filter(condition)
