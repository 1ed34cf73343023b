"""Typed tables kept as parquet, by year, between the load and the reports."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fieldtally.operators.lookups import Codebook
from fieldtally.plans.options import facets
from fieldtally.plans.typed import SurveyTables

FACETS = ["year", "month", "quarter", "week", "province", "province_group", "area_code"]
NAMES = ("capture", "aquaculture", "processing", "patrol")


def stage_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes a typed table by year.

    The rebalance hint makes files of an even size: a year with most of the rows is split over
    many writers, small years share one.  Rows are sorted by date inside them, so that a quarter
    or a month skips what lies before and after.
    """
    even = df.hint("rebalance", "year").sortWithinPartitions("year", "date")
    even.write.mode(mode).option("compression", "zstd").partitionBy("year").parquet(path)


def stage_tables(tables: SurveyTables, path: str) -> None:
    """The four tables, and next to them the filter values that occur, for option lists."""
    for name in NAMES:
        stage_table(getattr(tables, name), f"{path}/{name}")
    kept = StagedTables(tables.capture.sparkSession, path, tables.codes)
    stage_facets(kept.all, path, "load")


def stage_facets(tables: Iterable[DataFrame], path: str, part: str) -> None:
    """Adds the filter values of some rows; a part written again replaces what it was."""
    facets(tables).select(FACETS).repartition(1).write.mode("overwrite").parquet(f"{path}/facets/part={part}")


class StagedTables(SurveyTables):
    """Typed tables as `stage_tables` left them; year filters skip the other years' folders."""

    def __init__(self, spark: SparkSession, path: str, codes: Codebook):
        self.codes = codes
        self._spark, self._path = spark, path

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/{name}")

    @cached_property
    def capture(self) -> DataFrame:
        return self._read("capture")

    @cached_property
    def aquaculture(self) -> DataFrame:
        return self._read("aquaculture")

    @cached_property
    def processing(self) -> DataFrame:
        return self._read("processing")

    @cached_property
    def patrol(self) -> DataFrame:
        return self._read("patrol")

    @cached_property
    def offered(self) -> tuple[DataFrame, ...]:
        """The filter values kept with the tables; of tables without them, the tables."""
        try:
            return (self._read("facets").select(FACETS),)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.all
