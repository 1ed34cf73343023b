"""The code lists of the form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("list_name", "name", "label_khmer", "label_english")


def read_choices(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The choices table from files, or from JDBC with ``fmt="jdbc"`` and the caller's options."""
    reader = spark.read.format(fmt).options(**(options or {}))
    return (reader.load(path) if path else reader.load()).select(*COLUMNS)
