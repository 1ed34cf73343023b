"""Row-level enriched tables: typed columns, calendar parts, group and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.lookups import (
    AREA_LIST,
    FISH_LIST,
    PROCESSED_LIST,
    PROVINCE_LIST,
    Codebook,
)
from fieldtally.plans import typed


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("date"))


def enrich_submissions(df: DataFrame, codes: Codebook) -> DataFrame:
    return codes.label(_dated(typed.typed_submissions(df)), PROVINCE_LIST)


def enrich_capture(df: DataFrame, codes: Codebook) -> DataFrame:
    return codes.label(_dated(typed.typed_capture(df)), PROVINCE_LIST, FISH_LIST, AREA_LIST)


def enrich_aquaculture(df: DataFrame, codes: Codebook) -> DataFrame:
    return codes.label(_dated(typed.typed_aquaculture(df)), PROVINCE_LIST, FISH_LIST, AREA_LIST)


def enrich_processing(df: DataFrame, codes: Codebook) -> DataFrame:
    frame = _dated(typed.typed_processing(df))
    return codes.label(frame, PROVINCE_LIST, AREA_LIST, PROCESSED_LIST)


def enrich_patrol(df: DataFrame, codes: Codebook) -> DataFrame:
    return codes.label(_dated(typed.typed_patrol(df)), PROVINCE_LIST)


def combined_catch(capture: DataFrame, aquaculture: DataFrame) -> DataFrame:
    """Enriched capture and aquaculture under one another, by kind of catch."""
    kind = (
        F.when(F.col("area_code") == "1", "Freshwater Capture")
        .when(F.col("area_code") == "2", "Marine Capture")
        .otherwise("Other Capture")
    )
    shared = ["year", "month", "quarter", "catch"]
    wild = capture.select(
        *shared, F.col("province_en").alias("province"), "area_en", "area_code",
        kind.alias("area_group"),
    )
    farmed = aquaculture.select(
        *shared, F.col("province_kh").alias("province"), F.lit("Aquaculture").alias("area_group")
    )
    return wild.unionByName(farmed, allowMissingColumns=True)
