"""Column functions over the dates of accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STALE_DAYS


def months_between(start: Column, end: Column) -> Column:
    """Months of 30.44 days from one ISO date to another, rounded; null if one isn't a date."""
    days = F.datediff(F.try_to_date(end), F.try_to_date(start))
    return F.rint(days / F.lit(30.44)).cast("int")


def made_up_to_text(description: Column) -> Column:
    """``31 March 2025`` from a filing's description, or the empty string."""
    return F.regexp_extract(F.coalesce(description, F.lit("")), r"(?U)made up to (\d{1,2} \w+ \d{4})", 1)


def made_up_to(description: Column) -> Column:
    """That date, or null if there is none or it isn't one."""
    return F.try_to_date(made_up_to_text(description), "d MMMM yyyy")


def is_stale(made_up: Column, as_of: Column) -> Column:
    return F.coalesce(F.datediff(as_of, made_up) > STALE_DAYS, F.lit(False))


def is_odd_period(months: Column) -> Column:
    return F.coalesce((months != 0) & ~months.between(11, 13), F.lit(False))
