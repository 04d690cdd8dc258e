"""Seasons, periods, staleness and date forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(day: Column) -> Column:
    """`2025-26`; seasons begin in July."""
    start = F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def next_reset(ts: Column) -> Column:
    return F.add_months(F.trunc(F.to_date(ts), "MM"), 1)


def stale_team(last: Column, as_of: Column, days: int = 7) -> Column:
    return last.isNull() | (as_of - last > F.make_dt_interval(F.lit(days)))


def stale_tournament(last: Column, end_date: Column, as_of: Column) -> Column:
    """Not looked at for a day, unless it ended more than a day ago."""
    day = F.make_dt_interval(F.lit(1))
    old = last.isNull() | (as_of - last > day)
    over = F.to_timestamp(end_date) < as_of - day
    return old & ~F.coalesce(over, F.lit(False))


def iso_of_compact(c: Column) -> Column:
    return F.regexp_replace(c, "^(\\d{4})(\\d{2})(\\d{2}).*$", "$1-$2-$3")


def day_heading(ts: Column, as_of: Column) -> Column:
    n = F.datediff(as_of, ts)
    return F.when(n == 0, "Today").when(n == 1, "Yesterday").otherwise(F.date_format(ts, "MMMM d, yyyy"))


def session_valid(expires: Column, as_of: Column) -> Column:
    return expires > as_of


def may_rename(last: Column, as_of: Column, hours: int = 24) -> Column:
    return last.isNull() | (as_of - last >= F.make_dt_interval(F.lit(0), F.lit(hours)))
