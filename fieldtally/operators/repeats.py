"""Repeat groups and multi-select answers to tidy rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions import answers


def require_results(df: DataFrame, field: str = "results") -> DataFrame:
    if field not in df.columns:
        raise ValueError(f"the payload has no field {field!r}")
    return df


def explode_repeat(
    df: DataFrame, repeat: str, keys: Iterable[str], expected: T.StructType | None = None
) -> DataFrame:
    """One row per element of a repeat group, with ``pos`` and the parent's keys.

    A parent without elements gives no row.  A table without the repeat group gives an empty
    table of the ``expected`` element fields, with a warning.
    """
    carried = [k for k in keys if k in df.columns]
    if repeat not in df.columns:
        warnings.warn(f"no field {repeat!r} in the submissions", stacklevel=2)
        fields = [df.schema[k] for k in carried] + [T.StructField("pos", T.IntegerType())]
        fields += expected.fields if expected else []
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    rows = df.select(*[f"`{k}`" for k in carried], F.posexplode(repeat).alias("pos", "element"))
    return rows.select(*[f"`{k}`" for k in carried], "pos", "element.*")


def explode_codes(df: DataFrame, column: str, name: str, keep: Iterable[str] | None = None) -> DataFrame:
    """One row per code of a multi-select answer, repeats kept; ``keep`` lists wanted codes."""
    rows = df.withColumn(name, F.explode(answers.codes_in(F.col(column))))
    return rows if keep is None else rows.where(F.col(name).isin(*keep))


def explode_facilities(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per facility type named in a free text; a text that names none gives no row."""
    return df.withColumn(name, F.explode(answers.facilities_in(F.col(column))))
