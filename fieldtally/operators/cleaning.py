"""Column-wise cleaning of raw submission tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally import domains as D
from fieldtally.functions import answers, coercion


def clean_name(name: str) -> str:
    """Lower case, everything but letters and digits to ``_``, no ``_`` at either end."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def normalize_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns that become the same name: {twice}")
    return df.toDF(*names)


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterable[tuple[str, ...]]:
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here)
        else:
            yield here


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested objects to flat columns, at any depth; arrays stay as they are."""
    return df.select(
        *[
            F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
            for path in _leaves(df.schema)
        ]
    )


def select_present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[f"`{c}`" for c in wanted if c in have])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def drop_repeats(df: DataFrame) -> DataFrame:
    return df.drop(*D.REPEATS)


def ensure_columns(df: DataFrame, names: Iterable[str], value: int | Column = 0) -> DataFrame:
    missing = {n: value if isinstance(value, Column) else F.lit(value) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first of the candidate names the table has."""
    return next((c for c in candidates if c in df.columns), None)


def _of_type(df: DataFrame, kind: type, only: Iterable[str] | None = None) -> list[str]:
    chosen = set(df.columns if only is None else only)
    return [f.name for f in df.schema.fields if f.name in chosen and isinstance(f.dataType, kind)]


def _replace(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns)) if columns else df


def list_to_text(df: DataFrame) -> DataFrame:
    """Every array column to comma-separated text."""
    lists = _of_type(df, T.ArrayType)
    return _replace(df, {c: answers.list_text(F.col(c)) for c in lists})


def fill_missing_text(df: DataFrame) -> DataFrame:
    """NULL and empty text columns become ``null``."""
    texts = _of_type(df, T.StringType)
    return _replace(df, {c: answers.null_token(F.col(c)) for c in texts})


def fill_unspecified(df: DataFrame) -> DataFrame:
    """NULL text becomes ``unspecified``."""
    texts = _of_type(df, T.StringType)
    return df.fillna(D.UNSPECIFIED, subset=texts) if texts else df


def fill_zero(df: DataFrame, measures: list[str]) -> DataFrame:
    """NULL in the named measures becomes 0; keys are never touched."""
    return df.fillna(0, subset=measures) if measures else df


def blank_to_null_token(df: DataFrame) -> DataFrame:
    """Empty text becomes ``null``; NULL stays NULL."""
    texts = _of_type(df, T.StringType)
    return _replace(df, {c: answers.blank_token(F.col(c)) for c in texts})


def multiselect_to_text(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    listed = isinstance(df.schema[name].dataType, T.ArrayType)
    text = answers.multiselect_text if listed else answers.multiselect_json_text
    return df.withColumn(name, text(F.col(name)))


def cast_integer(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text columns, where present, to int; a bad answer is NULL."""
    texts = _of_type(df, T.StringType, names)
    return _replace(df, {c: coercion.to_integer(F.col(c)) for c in texts})


def cast_double(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text columns, where present, to double; a bad answer is NULL."""
    texts = _of_type(df, T.StringType, names)
    return _replace(df, {c: coercion.to_double(F.col(c)) for c in texts})


def stringify_all(df: DataFrame) -> DataFrame:
    """Every column as text; days as ``yyyy-MM-dd``, moments as ``yyyy-MM-dd HH:mm:ss``."""

    def text(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if isinstance(field.dataType, T.TimestampNTZType):
            return coercion.moment_text(c)
        return c.cast("string")

    return df.select(*[text(f).alias(f.name, metadata=f.metadata) for f in df.schema.fields])
