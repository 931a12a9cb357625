"""Calendar expressions (operator O-50 and friends)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import col


def month_start(d) -> Column:
    return F.trunc(col(d).cast("date"), "month")


def month_year_text(d) -> Column:
    """``MM-yyyy`` label of a month (the reference's display key)."""
    return F.date_format(col(d), "MM-yyyy")


def month_name(d) -> Column:
    return F.date_format(col(d), "MMMM")


def weekday_name(d) -> Column:
    return F.date_format(col(d), "EEEE")


def weekday_num(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(d))


def iso_week(d) -> Column:
    return F.weekofyear(col(d))


def iso_week_year(d) -> Column:
    """ISO week-numbering year; pairs with ``iso_week`` for a sound week key."""
    return F.extract(F.lit("YEAROFWEEK"), col(d).cast("date")).cast("int")


def month_index(d) -> Column:
    """Months since year 0: consecutive months differ by exactly 1."""
    c = col(d)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")
