"""Where queries and their SQL counterparts are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name!r}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def shown(column: Column | str) -> Column:
    """A value as text, ``NA`` where missing."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit("NA"))


def shown_sql(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), 'NA')"
