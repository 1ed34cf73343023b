"""Option lists of the filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions import calendar
from fieldtally.operators import filters as flt
from fieldtally.plans import options as O
from fieldtally.registry.core import query, shown
from fieldtally.registry.sql import group_of, with_tables
from fieldtally.sources import star

FOUR = ("capture", "aqu", "processing", "patrol")


def distinct_sql(columns: str, tables=FOUR, where: str = "TRUE") -> str:
    parts = " UNION ".join(f"SELECT {columns} FROM {t}" for t in tables)
    return with_tables(f"SELECT * FROM ({parts}) WHERE {where}", *tables)


@query("years_available", distinct_sql("year"))
def _(spark, sf):
    return O.years_available(star.tables(spark, sf).all)


@query("quarters_available", distinct_sql("quarter"))
def _(spark, sf):
    return O.quarters_available(star.tables(spark, sf).all)


MONTHS = distinct_sql("month, strftime(make_date(2000, month, 1), '%B') AS month_name")


@query("months_available", MONTHS)
def _(spark, sf):
    return O.months_available(star.tables(spark, sf).all)


@query("weeks_available", distinct_sql("week"))
def _(spark, sf):
    return O.weeks_available(star.tables(spark, sf).all)


@query("groups_available", distinct_sql("province_group"))
def _(spark, sf):
    return O.groups_available(star.tables(spark, sf).all)


@query("provinces_available", distinct_sql("province_kh, province_en"))
def _(spark, sf):
    tables = star.tables(spark, sf)
    return O.provinces_available(tables.all, tables.codes)


@query("areas_available", distinct_sql("area_en", FOUR[:3]))
def _(spark, sf):
    tables = star.tables(spark, sf)
    return O.areas_available(tables.with_area, tables.codes)


SOURCES = with_tables("SELECT DISTINCT proc_code AS processing_source FROM processing", "processing")


@query("processing_sources", SOURCES)
def _(spark, sf):
    answered = star.tables(spark, sf).processing.withColumnRenamed("proc_code", "processing_source")
    return O.processing_sources(answered)


@query("option_facets", with_tables(
    """SELECT DISTINCT year, month, quarter, week, province, province_group, area_code
    FROM (SELECT year, month, quarter, week, province, province_group, area_code FROM capture
        UNION ALL SELECT year, month, quarter, week, province, province_group, area_code FROM aqu
        UNION ALL SELECT year, month, quarter, week, province, province_group, area_code
        FROM processing
        UNION ALL SELECT year, month, quarter, week, province, province_group, 'NA' FROM patrol)""",
    *FOUR,
))
def _(spark, sf):
    found = O.facets(star.tables(spark, sf).all)
    return found.withColumn("area_code", shown("area_code"))


@query("provinces_for_group", with_tables(
    f"""SELECT code AS province, province_kh, province_en, {group_of('code')} AS province_group
    FROM provinces WHERE {group_of('code')} = 'Marine'""",
    "provinces",
))
def _(spark, sf):
    return O.provinces_for_group(star.codebook(spark, sf), "Marine")


@query("areas_for_group", distinct_sql("area_en", FOUR[:3], "NOT contains(lower(trim(area_en)), 'marine')"))
def _(spark, sf):
    tables = star.tables(spark, sf)
    return O.areas_for_group(O.areas_available(tables.with_area, tables.codes), "Inland")


@query("months_for_quarter", MONTHS.replace("WHERE TRUE", "WHERE month BETWEEN 4 AND 6"))
def _(spark, sf):
    return O.months_for_quarter(O.months_available(star.tables(spark, sf).all), 2)


@query(
    "month_to_quarter",
    """SELECT CAST(l_linenumber + CAST(l_quantity AS INTEGER) % 8 AS INTEGER) AS month,
        coalesce(CASE WHEN l_linenumber + CAST(l_quantity AS INTEGER) % 8 <= 12
        THEN 'Q' || CAST(ceil((l_linenumber + CAST(l_quantity AS INTEGER) % 8) / 3.0) AS INTEGER) END, 'NA')
        AS quarter, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    items = star.table(spark, sf, "lineitem")
    month = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 8
    return items.groupBy(
        month.alias("month"), shown(calendar.month_to_quarter(month)).alias("quarter")
    ).agg(F.count(F.lit(1)).alias("n"))


RECONCILED = """SELECT month, quarter,
    coalesce(CASE WHEN 'Q' || quarter_of_month = quarter THEN CAST(month AS VARCHAR) END, 'NA')
    AS month_kept, count(*) AS n
    FROM (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, quarter(o_orderdate) AS quarter_of_month,
        'Q' || CAST(o_custkey % 4 + 1 AS INTEGER) AS quarter FROM orders)
    GROUP BY 1, 2, 3"""


@query("reconcile_filters", RECONCILED)
def _(spark, sf):
    """A quarter is chosen after a month, in every order's row."""
    orders = star.table(spark, sf, "orders")
    number = (F.col("o_custkey") % 4 + 1).cast("int")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("group", "province", "area")]

    def selection(quarter: Column) -> Column:
        return F.struct(*nothing, quarter.alias("quarter"), F.month("o_orderdate").alias("month"))

    chosen = orders.select(
        selection(F.lit(None).cast("int")).alias("old"), selection(number).alias("new"), F.lit(None).cast("array<string>").alias("areas")
    )
    found = flt.reconcile_selections(chosen)
    return found.groupBy(
        F.col("new.month").alias("month"),
        F.concat(F.lit("Q"), F.col("new.quarter").cast("string")).alias("quarter"),
        shown(F.col("kept.month")).alias("month_kept"),
    ).agg(F.count(F.lit(1)).alias("n"))
