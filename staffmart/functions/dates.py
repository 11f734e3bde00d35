"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"  # fixed value: end of a version that is still valid


def open_end() -> Column:
    return F.lit(OPEN_END).cast("date")


def date_key(date: Column) -> Column:
    """20240131 for 2024-01-31."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def calendar_columns(date: Column) -> list[Column]:
    """The seven columns of the date dimension."""
    return [
        date_key(date).alias("date_sk"),
        date.alias("full_date"),
        F.dayofmonth(date).alias("day_of_month"),
        F.month(date).alias("month_num"),
        F.date_format(date, "MMMM").alias("month_name"),
        F.quarter(date).alias("quarter_num"),
        F.year(date).alias("year_num"),
    ]


def completed_years(start: Column, end: Column) -> Column:
    """Whole years from start to end; an anniversary on 29 February counts from 1 March."""
    before_anniversary = (F.month(end) * 100 + F.dayofmonth(end)
                          < F.month(start) * 100 + F.dayofmonth(start))
    return F.year(end) - F.year(start) - before_anniversary.cast("int")


def as_of_date(as_of) -> Column:
    """A fixed report date, or today when None."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
