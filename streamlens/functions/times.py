"""Dates, windows of dates and clock texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_bounds(day: Column, shift: int = 0) -> tuple[Column, Column]:
    """First and last day of the month, shifted by months."""
    first = F.trunc(F.add_months(F.trunc(day, "MM"), shift), "MM")
    return first, F.last_day(first)


def rolling_bounds(today: Column, days: int) -> tuple[Column, Column]:
    """The inclusive window of so many days that ends today."""
    return F.date_sub(today, days - 1), today


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def valid_date(x: Column) -> Column:
    """A date from YYYY-MM-DD, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))))


def utc_timestamp(x: Column) -> Column:
    """A timestamp from ISO 8601 text that names its offset; naive or invalid text gives null."""
    return F.when(x.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(x))


def local_date(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, r = (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def subtitle_clock(seconds: Column) -> Column:
    """H:MM:SS.cc in hundredths."""
    cs = F.bround(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    s = (cs / 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60, cs % 100)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without zone, as UTC, with its fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)
