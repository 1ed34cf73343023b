"""Calendar parts of a submission date."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(date: Column) -> Column:
    return F.year(date)


def month_of(date: Column) -> Column:
    return F.month(date)


def quarter_of(date: Column) -> Column:
    """``Q1`` to ``Q4``; NULL for a missing date."""
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


def week_number(date: Column) -> Column:
    """Week of the month, 1 to 5, counted from the first day."""
    return F.ceil(F.dayofmonth(date) / 7).cast("int")


def week_of_month(date: Column) -> Column:
    """``Week1`` to ``Week5``; ``WeekNA`` for a missing date."""
    return F.concat(F.lit("Week"), F.coalesce(week_number(date).cast("string"), F.lit("NA")))


def month_abbr(date: Column) -> Column:
    return F.date_format(date, "MMM")


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def month_to_quarter(month: Column) -> Column:
    """``Q1`` to ``Q4`` of a month number; NULL outside 1 to 12."""
    return F.when(
        month.between(1, 12), F.concat(F.lit("Q"), F.ceil(month / 3).cast("string"))
    )


def day(value: datetime.date) -> Column:
    """A day as a constant, of any year a date can have."""
    return F.lit(value.isoformat()).cast("date")


def in_months(date: Column, year: int, first: int, last: int) -> Column:
    """Dates of a year's months ``first`` to ``last``, as a range, so that a scan can skip files by it.

    A year no date can have leaves the range open, or empty, at its end.
    """
    met = F.lit(year <= datetime.MAXYEAR) & F.lit(year >= datetime.MINYEAR)
    if datetime.MINYEAR <= year <= datetime.MAXYEAR:
        met = date >= day(datetime.date(year, first, 1))
        after = datetime.date(year, last, 28) + datetime.timedelta(days=4) if (year, last) < (datetime.MAXYEAR, 12) else None
        if after is not None:
            met &= date < day(after.replace(day=1))
    return met


def in_years(date: Column, first: int, last: int) -> Column:
    """Dates of the years ``first`` to ``last``, as a range; open where no date lies beyond."""
    met = date.isNotNull()
    if first > datetime.MINYEAR:
        met &= date >= day(datetime.date(first, 1, 1))
    if last < datetime.MAXYEAR:
        met &= date < day(datetime.date(last + 1, 1, 1))
    return met
