"""Date helpers: day-of, time buckets, date windows and the refresh cutoff."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import GRANULARITIES


def day_of(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """DATE / TIMESTAMP / ISO-string time value -> DATE (PRJ-4)."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, T.StringType):
        return F.try_to_date(c)
    return F.to_date(c)


def time_bucket(day: Column | str, granularity: str) -> Column:
    """Bucket start as DATE: the day itself, Monday of its week, or the 1st of its month (PRJ-1)."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"invalid granularity '{granularity}'")
    c = F.col(day) if isinstance(day, str) else day
    if granularity == "day":
        return c
    return F.trunc(c, granularity)


def bucket_start(d: _dt.date, granularity: str) -> _dt.date:
    """Driver-side twin of :func:`time_bucket` for a single literal date."""
    if granularity == "week":
        return d - _dt.timedelta(days=d.weekday())
    if granularity == "month":
        return d.replace(day=1)
    return d


def refresh_cutoff(today: _dt.date, window_days: int = 5) -> _dt.date:
    """First day of the trailing window that is always re-fetched (REF-4)."""
    return today - _dt.timedelta(days=max(1, window_days) - 1)


def expand_windows(from_date: _dt.date, to_date: _dt.date, size: int) -> list[tuple[_dt.date, _dt.date]]:
    """REF-1: inclusive windows of ``size`` days that tile the range; the last
    may be short. A list as long as the plan, never data."""
    if size < 1:
        raise ValueError("window size must be >= 1")
    step = _dt.timedelta(days=size)
    count = -(-((to_date - from_date).days + 1) // size)
    starts = [from_date + i * step for i in range(count)]
    return [(a, min(a + step - _dt.timedelta(days=1), to_date)) for a in starts]


def date_windows(ranges: DataFrame, n: int) -> DataFrame:
    """REF-1 as a plan: the contiguous ``n``-day windows (window_start, window_end) of
    each row's from_date to to_date, the last one short; none for an inverted
    range or one with a null end."""
    if n < 1:
        raise ValueError("a window has at least one day")
    starts = F.expr(f"sequence(from_date, to_date, INTERVAL {n} DAY)")
    out = ranges.where("from_date <= to_date").withColumn("window_start", F.explode(starts))
    return out.withColumn("window_end", F.least(F.date_add("window_start", n - 1), "to_date"))
