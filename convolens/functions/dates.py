"""Dates of billing cycles and the reference formats of transaction dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cycle_end(day: Column) -> Column:
    """The last day of a date's month (December stays in its own year)."""
    return F.last_day(day)


def next_month(day: Column) -> tuple[Column, Column]:
    """First and last day of the month after a date."""
    start = F.add_months(F.trunc(day, "month"), 1)
    return start, F.last_day(start)


def two_format_date(text: Column) -> Column:
    """A date written as month/day/year or year-month-day; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("MM/dd/yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
