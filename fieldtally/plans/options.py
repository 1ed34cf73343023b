"""What each filter offers.

Every list is a distinct over one or two columns of the typed tables.  `facets` takes them all
from one pass; the lists accept it in place of the tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import answers, calendar
from fieldtally.operators.filters import filter_group_only
from fieldtally.operators.lookups import AREA_LIST, PROVINCE_LIST, Codebook

# The columns the others follow from.
FACET_COLUMNS = ("year", "month", "week", "province", "area_code")


def _distinct(tables: Iterable[DataFrame], *columns: str) -> DataFrame:
    parts = [t.select(*columns) for t in tables]
    return reduce(DataFrame.unionAll, parts).distinct()


def facets(tables: Iterable[DataFrame]) -> DataFrame:
    """The combinations of filter values that occur; as few rows as the form has answers."""
    parts = [
        t if "area_code" in t.columns else t.withColumn("area_code", F.lit(None).cast("string"))
        for t in tables
    ]
    return _distinct(parts, *FACET_COLUMNS).withColumns({
        "quarter": calendar.month_to_quarter(F.col("month")),
        "province_group": answers.province_group(F.col("province")),
    })


def _sorted_values(tables: Iterable[DataFrame], column: str) -> DataFrame:
    return _distinct(tables, column).where(F.col(column).isNotNull()).orderBy(column)


def years_available(tables: Iterable[DataFrame]) -> DataFrame:
    return _sorted_values(tables, "year")


def quarters_available(tables: Iterable[DataFrame]) -> DataFrame:
    return _sorted_values(tables, "quarter")


def months_available(tables: Iterable[DataFrame]) -> DataFrame:
    months = _sorted_values(tables, "month")
    return months.withColumn("month_name", calendar.month_name(F.col("month")))


def weeks_available(tables: Iterable[DataFrame]) -> DataFrame:
    """Weeks in order; rows without a date have none to offer."""
    return _distinct(tables, "week").where(F.col("week").isin(*D.WEEKS)).orderBy("week")


def groups_available(tables: Iterable[DataFrame]) -> DataFrame:
    groups = _distinct(tables, "province_group")
    return groups.orderBy(answers.group_order(F.col("province_group")))


def province_labels(tables: Iterable[DataFrame], codes: Codebook) -> DataFrame:
    """Both labels of the provinces in the data; codes are made distinct before they are joined."""
    labelled = codes.label(_distinct(tables, "province"), PROVINCE_LIST)
    return labelled.select("province_kh", "province_en").distinct().dropna()


def provinces_available(tables: Iterable[DataFrame], codes: Codebook) -> DataFrame:
    """`province_labels` by English name."""
    return province_labels(tables, codes).orderBy("province_en", "province_kh")


def areas_available(tables: Iterable[DataFrame], codes: Codebook) -> DataFrame:
    labelled = codes.label(_distinct(tables, "area_code"), AREA_LIST)
    return labelled.select("area_en").distinct().dropna().orderBy("area_en")


def processing_sources(processing: DataFrame) -> DataFrame:
    """Distinct sources; none where the form does not ask for one."""
    column = "processing_source"
    if column not in processing.columns:
        return processing.where(F.lit(False)).select(F.lit(None).cast("string").alias(column))
    return _sorted_values([processing], column)


def provinces_for_group(codes: Codebook, group: str | None) -> DataFrame:
    """The listed provinces of a group, all of them for none."""
    listed = codes.list(PROVINCE_LIST)
    grouped = listed.withColumn("province_group", answers.province_group(F.col("province")))
    return filter_group_only(grouped, group)


def areas_for_group(areas: DataFrame, group: str | None) -> DataFrame:
    """Inland does not offer marine areas."""
    if group != D.INLAND:
        return areas
    return areas.where(~F.lower(F.trim("area_en")).contains("marine"))


def months_for_quarter(months: DataFrame, quarter: int | None) -> DataFrame:
    if quarter is None:
        return months
    return months.where(calendar.month_to_quarter(F.col("month")) == f"Q{quarter}")
