"""Partial sums of the typed tables, which reports add up instead of rows.

A cell is what rows of one year, month, week and combination of codes have in common: as few as
the form has answers, whatever the number of rows.  Its ``date`` is one of theirs, so the filters
of a report hold for a cell as they do for its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import answers, coercion
from fieldtally.operators.repeats import explode_codes

PERIOD = ["year", "month", "quarter", "week", "province", "province_group"]
#: A column that only cells have: how many rows each holds.
ROWS = "cell_rows"


def is_cells(df: DataFrame) -> bool:
    return ROWS in df.columns


def capture_cells(capture: DataFrame) -> DataFrame:
    """Rounded catch, that above zero, and the first submission, by codes."""
    whole = coercion.rounded(F.col("catch"))
    return capture.groupBy(*PERIOD, "area_code", "fishing_type", "fish_code").agg(
        F.min("date").alias("date"),
        F.sum(whole).alias("catch"),
        F.sum(F.when(whole > 0, whole)).alias("positive"),
        F.min("id").alias("first_id"),
        F.count("*").alias(ROWS),
    )


def aquaculture_cells(aquaculture: DataFrame) -> DataFrame:
    """Catch above zero and the rows that have one, and rows by kind of facility, by codes."""
    grown = coercion.present(F.col("catch")) > 0
    kinds = []
    if "aqu_type" in aquaculture.columns:
        kinds = [F.count_if(answers.has_facility(F.col("aqu_type"), kind)).alias(kind) for kind in D.FACILITIES]
    return aquaculture.groupBy(*PERIOD, "area_code", "fish_code").agg(
        F.min("date").alias("date"),
        F.sum(F.when(grown, F.col("catch"))).alias("catch"),
        F.count_if(grown).alias("grown"),
        *kinds,
        F.count("*").alias(ROWS),
    )


def patrol_cells(patrol: DataFrame) -> DataFrame:
    """Cases by outcome."""
    cases = explode_codes(patrol, "patrol_enforcement", "code", D.OUTCOMES)
    counted = [F.count_if(F.col("code") == c).alias(label) for c, label in D.OUTCOMES.items()]
    return cases.groupBy(*PERIOD).agg(F.min("date").alias("date"), *counted, F.count("*").alias(ROWS))


CELLS = {"capture": capture_cells, "aquaculture": aquaculture_cells, "patrol": patrol_cells}
