"""Seeded, engine-independent pseudo-random draws.

A draw is a pure function of ``(seed, key, draw_no)``: the first 32 bits of
``md5('<seed>:<key>:<draw_no>')`` read as an unsigned integer in
``[0, 2**32)``.  Re-running a job (or a lost task) gives the same draws, and
any SQL engine with ``md5`` reproduces them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2 ** 32


def draw_hash(seed: int, key: Column, draw_no: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(int(seed))), key.cast("string"),
                       draw_no.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draws(seed: int, key: Column, k: int) -> Column:
    """ARRAY<BIGINT> of the k draws of one key."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(k) - 1)),
                       lambda j: draw_hash(seed, key, j))
