"""Sums, cross-tabs, zero rows and order.

The tables here come out of an aggregate and are small, but nothing below relies on that except
`column_values`, which checks it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally import domains as D
from fieldtally.functions import answers, coercion
from fieldtally.session import settle


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def group_sum(df: DataFrame, keys: Iterable[str], measure: str, name: str) -> DataFrame:
    """Sum per group; missing measures are left out, and a group of only those is 0."""
    return df.groupBy(*keys).agg(sum_or_zero(F.col(measure)).alias(name))


def group_count(df: DataFrame, keys: Iterable[str], name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def conditional_sum(
    df: DataFrame, keys: Iterable[str], measure: Column, where: Mapping[str, Column]
) -> DataFrame:
    """One sum per named predicate, all in one pass; without any, the keys alone."""
    if not where:
        return df.select(*keys).distinct()
    sums = [sum_or_zero(F.when(p, measure)).alias(n) for n, p in where.items()]
    return df.groupBy(*keys).agg(*sums)


def multi_column_sum(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_or_zero(F.col(f"`{c}`")).alias(c) for c in columns])


def column_values(df: DataFrame, column: str, order: Sequence[Column] = ()) -> list:
    """The distinct values that become columns, up to ``spark.sql.pivotMaxValues`` of them."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    values = df.groupBy(column).agg(F.lit(1).alias("__one"), *[
        o.alias(f"__o{i}") for i, o in enumerate(order)
    ])
    by = [F.col(f"__o{i}").asc_nulls_last() for i in range(len(order))] + [F.col(column)]
    rows = values.orderBy(*by).select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values of {column!r} to make columns of")
    return [r[0] for r in rows]


def pivot_wide(
    df: DataFrame, keys: Iterable[str], column: str, measure: str, values: Iterable | None = None
) -> DataFrame:
    """Long to wide, empty cells 0.

    ``values`` fixes the columns, a few, also such as the data lack: conditional sums, one
    shuffle.  Else the data are summed to cells, which are settled, and the columns are those of
    the cells, up to ``spark.sql.pivotMaxValues``; beyond that, stay with the long form.
    """
    keys = list(keys)
    if values is None:
        df = settle(group_sum(df, [*keys, column], measure, measure))
        return pivot_cells(df, keys, column, measure, [v for v in column_values(df, column) if v is not None])
    where = {str(v): F.col(column) == F.lit(v) for v in values}
    return conditional_sum(df, keys, F.col(measure), where)


def pivot_cells(df: DataFrame, keys: Iterable[str], column: str, measure: str, values: Sequence) -> DataFrame:
    """Cells to columns that come from the data: a row finds its column once, however many there are."""
    keys = list(keys)
    if not values:
        return df.select(*keys).distinct()
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.sum(measure))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values])


def pivot_map(
    df: DataFrame, keys: Iterable[str], column: str, measure: str, cells: str = "cells", total: str = "total"
) -> DataFrame:
    """Long to wide with any number of columns: a map from column to sum in each row, and the sum of all.

    The columns are in order; a missing one is called ``NA``, and no entry means 0.  Nothing is
    collected, so there is no limit as for columns of a table.
    """
    keys = list(keys)
    named = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("NA")))
    sums = group_sum(named, [*keys, column], measure, measure)
    entries = F.sort_array(F.collect_list(F.struct(column, measure)))
    return sums.groupBy(*keys).agg(F.map_from_entries(entries).alias(cells), F.sum(measure).alias(total))


def target_years(df: DataFrame, year: int | None, column: str = "year") -> list[int]:
    """The two years a report compares; for all years, the ones there are."""
    if year is not None:
        return [year - 1, year]
    return [y for y in column_values(df.where(F.col(column).isNotNull()), column)]


def observed_domain(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def domain_frame(spark: SparkSession, ordered: Sequence[str], key: str) -> DataFrame:
    """An ordered list as a table of values and their places."""
    placed = F.posexplode(answers.text_list(ordered)).alias("ord", key)
    return spark.range(0, 1, 1, 1).select(placed).select(key, "ord")


def missing_keys(domain: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return domain.join(df.select(key).distinct(), key, "left_anti")


def append_zero_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a summary, one per key, and a row of zeros for every other key.

    Zeros are put under all keys and summed in: the summary is computed once, not a second time
    to find out which keys it lacks.
    """
    measures = [f for f in df.schema.fields if f.name != key]
    zeros = keys.select(
        key, *[F.lit(0).cast(f.dataType).alias(f.name) for f in measures]
    )
    sums = [F.sum(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in measures]
    return df.unionByName(zeros).groupBy(key).agg(*sums)


def zero_fill_grid(
    cells: DataFrame, key: str, year: str, measure: str, domain: Sequence[str],
    years: Sequence[int] | None = None,
) -> DataFrame:
    """A cell for every pair of a domain value and a year, 0 where there is none.

    One row per year is summed, with a column per domain value, and then written out as cells.
    ``years`` fixes the years; else they are those of ``cells``.
    """
    rows = cells.select(key, year, measure)
    if years is None:
        rows = rows.where(F.col(year).isNotNull())
    else:
        fixed = F.explode(F.array(*[F.lit(y) for y in years])).alias(year)
        rows = rows.where(F.col(year).isin(*years)).unionByName(
            cells.sparkSession.range(0, 1, 1, 1).select(fixed), allowMissingColumns=True
        )
    each = {f"__{i}": F.col(key) == value for i, value in enumerate(domain)}
    wide = conditional_sum(rows, [year], F.col(measure), each)
    filled = [
        F.struct(F.lit(value).alias(key), F.col(name).alias(measure))
        for name, value in zip(each, domain)
    ]
    return wide.select(year, F.inline(F.array(*filled))).select(key, year, measure)


def merge_summaries(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two summaries, NULL keys matching, what is missing on the right 0."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    added = [c for c in right.columns if c not in keys]
    joined = left.join(other, same, "left").drop(*[f"__{k}" for k in keys])
    return joined.fillna(0, subset=added)


def row_total(df: DataFrame, columns: Sequence[str], name: str = D.TOTAL) -> DataFrame:
    parts = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns]
    return df.withColumn(name, reduce(lambda a, b: a + b, parts, F.lit(0)))


def round_outputs(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: coercion.rounded(F.col(f"`{c}`")) for c in columns})


def by_total(key: str, total: str) -> list[Column]:
    """Descending total; equal totals by key, a missing key last."""
    return [F.col(total).desc(), F.col(key).asc_nulls_last()]


def sort_desc_total(df: DataFrame, key: str, total: str = D.TOTAL) -> DataFrame:
    return df.orderBy(*by_total(key, total))


def sort_by_domain(df: DataFrame, key: str, ordered: tuple[str, ...]) -> DataFrame:
    """Rows in the order of a list, keys that are not in it last."""
    place = answers.position_in(F.col(key), ordered)
    return df.orderBy(place.asc_nulls_last(), F.col(key).asc_nulls_last())


def top_k(df: DataFrame, key: str, total: str = D.TOTAL, k: int = D.TOP_SPECIES) -> DataFrame:
    return sort_desc_total(df, key, total).limit(k)


def row_number(df: DataFrame, key: str, total: str, name: str) -> DataFrame:
    """Rank by descending total, 1 to n, without gaps.

    The sorted table is settled; its parts are numbered each by itself, and the count of the
    parts before is added.  Only those counts, one per part, meet in one task.
    """
    order = by_total(key, total)
    parted = settle(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    counts = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    starts = counts.select("__part", start)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = parted.withColumn(name, place).join(F.broadcast(starts), "__part")
    numbered = numbered.withColumn(name, (F.col(f"`{name}`") + F.col("__start")).cast("int"))
    return numbered.drop("__part", "__start")


def select_rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])
