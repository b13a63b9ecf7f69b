"""Dates as text, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_second(ts: Column) -> Column:
    """``2024-01-31T09:05:00Z``; an empty string for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def long_date(ts: Column) -> Column:
    """``January 31, 2024``."""
    return F.date_format(ts, "MMMM d, yyyy")


def shifted(ts: Column, *, days: Column | int = 0, minutes: Column | int = 0, months: Column | int = 0) -> Column:
    """A timestamp moved by months first (the day stays in the month), then days, then minutes."""
    of = lambda v: F.lit(v) if isinstance(v, int) else v
    return ts + F.make_interval(months=of(months)) + F.make_interval(days=of(days)) + F.make_interval(mins=of(minutes))
