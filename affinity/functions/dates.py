"""Date parameters and event-date normalisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType


def as_date(value) -> dt.date | None:
    """Accept ``date``, ``datetime``, ``'yyyyMMdd'`` or ``'yyyy-MM-dd'``."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value).strip().replace("-", "")
    return dt.datetime.strptime(text[:8], "%Y%m%d").date()


def days_before(value, days: int) -> dt.date:
    return as_date(value) - dt.timedelta(days=days)


def date_column(col: Column, data_type) -> Column:
    """Normalise an event date column to DATE.

    Strings follow the reference's reading: every ``-`` is removed and the
    first eight characters are read as ``yyyyMMdd``; anything unparsable
    becomes NULL (the loader keeps the row as an undated event).
    """
    if isinstance(data_type, DateType):
        return col
    if isinstance(data_type, (TimestampType, TimestampNTZType)):
        return F.to_date(col)
    if isinstance(data_type, StringType):
        digits = F.substring(F.regexp_replace(col, "-", ""), 1, 8)
        return F.try_to_date(digits, "yyyyMMdd")
    return F.try_to_date(col.cast("string"))


def in_range(col: Column, start=None, end=None) -> Column:
    """Both ends inclusive; ``None`` leaves a side open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (col >= F.lit(as_date(start)))
    if end is not None:
        cond = cond & (col <= F.lit(as_date(end)))
    return cond


def string_range(col: Column, start=None, end=None) -> Column:
    """A superset of ``in_range`` on the raw text of string dates, for Parquet pruning.

    Every accepted layout starts with the four digits of the year unless a
    ``-`` comes first, so the text is compared by year; text that starts below
    the digits is kept for the exact filter to judge.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & ((col >= F.lit(f"{as_date(start).year:04d}")) | (col < F.lit("0")))
    if end is not None:
        cond = cond & (col < F.lit(f"{as_date(end).year + 1:04d}"))
    return cond
