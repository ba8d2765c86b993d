"""Smoothed KL divergence as column expressions (dense array form).

Fixed values that must equal the reference for equal results:
logarithm base 10; zero-replacement value sigma = 0.0001; the mass given to
the zero slots is taken evenly from the non-zero slots.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (see module docstring)
SIGMA = 0.0001


def smooth_dense(p: Column) -> Column:
    """Replace zeros by SIGMA and take the same total mass from the non-zeros."""
    n_zero = F.size(F.filter(p, lambda v: v == 0.0))
    n_nonzero = F.size(p) - n_zero
    shift = F.try_divide(n_zero * F.lit(SIGMA), n_nonzero)
    return F.transform(p, lambda v: F.when(v == 0.0, F.lit(SIGMA))
                       .otherwise(v - F.coalesce(shift, F.lit(0.0))))


def kl_dense(p: Column, q: Column) -> Column:
    """sum_i p'_i * log10(p'_i / q'_i) over smoothed arrays of equal length.

    NULL when the lengths differ or a smoothed value is not positive (the
    logarithm is undefined there), so that one bad term cannot silently drop
    out of the sum.
    """
    ps, qs = smooth_dense(p), smooth_dense(q)
    terms = F.zip_with(ps, qs, lambda a, b: F.when((a > 0) & (b > 0),
                                                   a * F.log10(a / b)))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    bad = F.exists(terms, lambda t: t.isNull())
    return F.when((F.size(p) == F.size(q)) & ~bad, total)
