"""The seven report filters and the row predicates the reports start from."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import answers, calendar, coercion


def _number(value: object, prefix: str, low: int, high: int, what: str) -> int | None:
    if value is None or value == "All":
        return None
    found = re.fullmatch(rf"(?:{prefix})?(\d+)", str(value))
    if not found or not low <= int(found[1]) <= high:
        raise ValueError(f"not a {what}: {value!r}")
    return int(found[1])


@dataclass(frozen=True)
class Filters:
    """One selection; ``None`` or ``"All"`` switches a filter off."""

    group: str | None = None
    province: str | None = None
    area: str | None = None
    year: int | str | None = None
    quarter: int | str | None = None
    month: int | str | None = None
    week: int | str | None = None

    def __post_init__(self):
        for name in ("group", "province", "area"):
            if getattr(self, name) == "All":
                object.__setattr__(self, name, None)
        if self.group is not None and self.group not in D.GROUPS:
            raise ValueError(f"not a province group: {self.group!r}")
        numbers = {
            "year": _number(self.year, "", 1, 9999, "year"),
            "quarter": _number(self.quarter, "Q", 1, 4, "quarter"),
            "month": _number(self.month, "", 1, 12, "month"),
            "week": _number(self.week, "Week", 1, 5, "week"),
        }
        for name, value in numbers.items():
            object.__setattr__(self, name, value)

    def with_(self, **changes: object) -> "Filters":
        return replace(self, **changes)

    @property
    def needs_area_label(self) -> bool:
        return self.area is not None or self.group == D.INLAND


ALL = Filters()


def filter_group_only(df: DataFrame, group: str | None) -> DataFrame:
    return df if group is None else df.where(F.col("province_group") == group)


def inland_area(code: Column, label: Column) -> Column:
    """Area codes or labels that belong inland."""
    return code.isin(*D.AREA_FRESH_CODES) | F.lower(label).rlike("fresh|inland")


def filter_group(df: DataFrame, group: str | None) -> DataFrame:
    """Province group; inland provinces show inland areas only, marine ones show both."""
    chosen = filter_group_only(df, group)
    if group != D.INLAND:
        return chosen
    return chosen.where(inland_area(F.col("area_code"), F.col("area_en")))


def filter_province(df: DataFrame, province: str | None) -> DataFrame:
    return df if province is None else df.where(F.col("province_kh") == province)


def filter_area(df: DataFrame, area: str | None) -> DataFrame:
    return df if area is None else df.where(F.col("area_en") == area)


def _in_years(df: DataFrame, first: int, last: int, date: str) -> DataFrame:
    """As a range of dates, and of the ``year`` column of tables that are stored by year."""
    met = calendar.in_years(F.col(date), first, last)
    if "year" in df.columns:
        met &= F.col("year").between(first, last)
    return df.where(met)


def filter_year_exact(df: DataFrame, year: int | None, date: str = "date") -> DataFrame:
    return df if year is None else _in_years(df, year, year, date)


def filter_year_pair(df: DataFrame, year: int | None, date: str = "date") -> DataFrame:
    """The year and the one before it."""
    return df if year is None else _in_years(df, year - 1, year, date)


def filter_quarter(df: DataFrame, quarter: int | None, date: str = "date") -> DataFrame:
    return df if quarter is None else df.where(F.quarter(date) == quarter)


def filter_month(df: DataFrame, month: int | None, date: str = "date") -> DataFrame:
    return df if month is None else df.where(F.month(date) == month)


def filter_week(df: DataFrame, week: int | None, date: str = "date") -> DataFrame:
    return df if week is None else df.where(calendar.week_number(F.col(date)) == week)


def in_period(filters: Filters, date: str = "date", years: tuple[int, ...] | None = None) -> Column:
    """Quarter, month and week together, as one predicate on the date.

    Where the ``years`` are known, quarter and month are ranges of dates, which reach the scan.
    """
    met = F.lit(True)
    months = set(range(1, 13))
    if filters.quarter is not None:
        months &= set(months_of_quarter(filters.quarter))
    if filters.month is not None:
        months &= {filters.month}
    if years is not None and 0 < len(months) < 12:
        first, last = min(months), max(months)
        met &= reduce(or_, [calendar.in_months(F.col(date), y, first, last) for y in years])
    else:
        if filters.quarter is not None:
            met &= F.quarter(date) == filters.quarter
        if filters.month is not None:
            met &= F.month(date) == filters.month
    if filters.week is not None:
        met &= calendar.week_number(F.col(date)) == filters.week
    return met


def apply_labels(df: DataFrame, filters: Filters, area_rule: bool = True) -> DataFrame:
    """Group, province and area; ``area_rule=False`` for data that have no area."""
    if not area_rule:
        return filter_province(filter_group_only(df, filters.group), filters.province)
    grouped = filter_group(df, filters.group)
    return filter_area(filter_province(grouped, filters.province), filters.area)


def filter_date_present(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.col(date).isNotNull())


def filter_amount_present(df: DataFrame, amount: str) -> DataFrame:
    return df.where(F.col(amount).isNotNull())


def filter_positive(df: DataFrame, measure: str) -> DataFrame:
    """A measure that is there and above 0; NaN counts as missing."""
    return df.where(coercion.present(F.col(measure).cast("double")) > 0)


def filter_positive_rounded(df: DataFrame, measure: str, date: str = "date") -> DataFrame:
    """A date, and a measure that is above 0 once rounded, halves to even."""
    whole = coercion.rounded(F.col(measure))
    return df.where(F.col(date).isNotNull() & (whole > 0))


def filter_not_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with another value; NULL rows drop."""
    return df.where(F.col(column) != value)


def filter_in_list(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.where(f"`{column}` IN ({answers.quoted(values)})")


def filter_codes(df: DataFrame, **codes: str | None) -> DataFrame:
    for column, code in codes.items():
        df = df if code is None else df.where(F.col(column) == code)
    return df


def filter_key_present(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def months_of_quarter(quarter: int) -> tuple[int, ...]:
    return tuple(range(3 * quarter - 2, 3 * quarter + 1))


def reconcile_filters(old: Filters, new: Filters, areas: tuple[str, ...] | None = None) -> Filters:
    """What dependent filters become when one is changed.

    A new group puts the province back to All and keeps the area only if it is among ``areas``,
    the ones that group offers.  A new quarter keeps the month only if it lies in it.  A new
    month sets its quarter.
    """
    result = new
    if new.group != old.group:
        keeps = areas is None or new.area in areas
        result = result.with_(province=None, area=new.area if keeps else None)
    if new.quarter != old.quarter:
        if new.quarter is not None and new.month not in months_of_quarter(new.quarter):
            result = result.with_(month=None)
    elif new.month != old.month and new.month is not None:
        result = result.with_(quarter=(new.month + 2) // 3)
    return result


def reconcile_selections(df: DataFrame) -> DataFrame:
    """`reconcile_filters` for a table of selections, row by row.

    ``old`` and ``new`` are structs of ``group, province, area`` (texts), ``quarter, month`` (numbers), a
    missing value for All; ``areas`` has the areas the new group offers, missing for any.  The
    result is the column ``kept``, a struct of the same fields; other columns stay.
    """
    old, new = (lambda name: F.col(f"old.{name}")), (lambda name: F.col(f"new.{name}"))
    moved = lambda name: ~old(name).eqNullSafe(new(name))
    offered = F.col("areas").isNull() | F.coalesce(F.array_contains("areas", new("area")), F.lit(False))
    inside = F.ceil(new("month") / 3) == new("quarter")
    kept = {
        "group": new("group"),
        "province": F.when(~moved("group"), new("province")),
        "area": F.when(~moved("group") | offered, new("area")),
        "quarter": F.when(~moved("quarter") & moved("month") & new("month").isNotNull(), F.ceil(new("month") / 3).cast("int")).otherwise(new("quarter")),
        "month": F.when(~moved("quarter") | new("quarter").isNull() | inside, new("month")),
    }
    return df.withColumn("kept", F.struct(*[c.alias(n) for n, c in kept.items()]))
