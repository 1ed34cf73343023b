"""Cleaned tables with typed columns under uniform names; no joins.

A report works on these and puts labels to codes only once it has aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import answers, calendar, coercion
from fieldtally.operators.cleaning import resolve_column
from fieldtally.operators.lookups import Codebook


# Names the aquaculture type answer may go by, first found first.
TYPE_COLUMNS = ("aqu_fishcatch_aqu_type", "aqu_type", "aquaculture_type", "type", "aqu_type_raw")


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "year": calendar.year_of(date),
        "month": calendar.month_of(date),
        "quarter": calendar.quarter_of(date),
        "week": calendar.week_of_month(date),
    }


def code_column(df: DataFrame, name: str) -> Column:
    """A code as text; codes are never numbers."""
    return F.col(name).cast("string")


def _typed(df: DataFrame, columns: dict[str, Column], zeros: bool = True) -> DataFrame:
    keys = [c for c in ("id", "pos") if c in df.columns]
    dated = df.withColumn("date", coercion.date_of(df, "date"))
    return dated.select(
        *keys,
        "date",
        *[c.alias(n) for n, c in calendar_columns(F.col("date")).items()],
        code_column(df, "province").alias("province"),
        answers.province_group(F.col("province").cast("string"), zeros).alias("province_group"),
        *[c.alias(n) for n, c in columns.items()],
    )


def typed_submissions(df: DataFrame) -> DataFrame:
    """Submissions with a date; their province codes are numbers without leading zeros."""
    dated = df.where(F.col("date").isNotNull())
    dated = dated.withColumn("date", coercion.date_of(df, "date", slashes=False))
    return _typed(dated, {"month_abbr": calendar.month_abbr(F.col("date"))}, zeros=False)


def typed_capture(df: DataFrame) -> DataFrame:
    return _typed(df, {
        "catch": coercion.measure_of(df, "nat_fishcatch_nat_catch"),
        "area_code": code_column(df, "nat_fishcatch_area_nat"),
        "fishing_type": code_column(df, "nat_fishcatch_type_fishing"),
        "fish_code": code_column(df, "nat_fishcatch_nat_fishtype"),
    })


def typed_aquaculture(df: DataFrame) -> DataFrame:
    columns = {
        "catch": coercion.measure_of(df, "aqu_fishcatch_aqu_catch"),
        "area_code": code_column(df, "aqu_fishcatch_area_aqu"),
        "fish_code": code_column(df, "aqu_fishcatch_aqu_fishtype"),
    }
    kind = resolve_column(df, TYPE_COLUMNS)
    if kind is not None:
        columns["aqu_type"] = code_column(df, kind)
    return _typed(df, columns)


def typed_processing(df: DataFrame) -> DataFrame:
    """Rows with an amount.  The source column is kept where there is one."""
    columns = {
        "processing_amount": coercion.measure_of(df, "processing_amountprocessing"),
        "proc_code": code_column(df, "processing_typeprocessing"),
        "area_code": code_column(df, "processing_area_pro"),
    }
    if "processing_source" in df.columns:
        columns["processing_source"] = F.col("processing_source")
    return _typed(df.where(F.col("processing_amountprocessing").isNotNull()), columns)


def typed_patrol(df: DataFrame) -> DataFrame:
    return _typed(df, {
        "patrol_amountcrime": coercion.measure_of(df, "patrol_amount"),
        "patrol_enforcement": code_column(df, "patrol_enforcement"),
    })


class SurveyTables:
    """The typed repeat tables and the code lists.

    ``cleaned`` gives a cleaned table by name; a table is built when first asked for.
    """

    def __init__(self, cleaned: Callable[[str], DataFrame], codes: Codebook):
        self._cleaned = cleaned
        self.codes = codes

    @classmethod
    def of_cleaned(cls, codes: Codebook, **cleaned: DataFrame) -> "SurveyTables":
        """From cleaned frames named capture, aquaculture, processing and patrol."""
        return cls(cleaned.__getitem__, codes)

    @cached_property
    def capture(self) -> DataFrame:
        return typed_capture(self._cleaned("capture"))

    @cached_property
    def aquaculture(self) -> DataFrame:
        return typed_aquaculture(self._cleaned("aquaculture"))

    @cached_property
    def processing(self) -> DataFrame:
        return typed_processing(self._cleaned("processing"))

    @cached_property
    def patrol(self) -> DataFrame:
        return typed_patrol(self._cleaned("patrol"))

    @property
    def capture_cells(self) -> DataFrame:
        """What reports add up: the rows, or cells of them where these are kept."""
        return self.capture

    @property
    def aquaculture_cells(self) -> DataFrame:
        return self.aquaculture

    @property
    def patrol_cells(self) -> DataFrame:
        return self.patrol

    @property
    def all(self) -> tuple[DataFrame, ...]:
        return self.capture, self.aquaculture, self.processing, self.patrol

    @property
    def offered(self) -> tuple[DataFrame, ...]:
        """What option lists and province lists are made from."""
        return self.all

    @property
    def with_area(self) -> tuple[DataFrame, ...]:
        return self.capture, self.aquaculture, self.processing
