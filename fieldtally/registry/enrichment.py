"""Typed columns, calendar parts, groups and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtally.functions import answers, calendar, coercion
from fieldtally.operators import filters as flt
from fieldtally.operators import lookups
from fieldtally.plans import clean, enrich, typed
from fieldtally.registry.core import query, shown, shown_sql
from fieldtally.registry.sql import calendar as calendar_sql
from fieldtally.registry.sql import group_of, with_tables
from fieldtally.session import shared_folder
from fieldtally.sources import dealt, star

# Dates of which some are missing, so that calendar parts of nothing show.
DATES = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d
    FROM orders"""


def _dates(spark, sf):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("d"))


@query("filter_date_present", f"SELECT id FROM ({DATES}) WHERE d IS NOT NULL")
def _(spark, sf):
    return flt.filter_date_present(_dates(spark, sf), "d").select("id")


@query("year_of", f"SELECT id, {shown_sql('year(d)')} AS year FROM ({DATES})")
def _(spark, sf):
    return _dates(spark, sf).select("id", shown(calendar.year_of(F.col("d"))).alias("year"))


@query("month_of", f"SELECT id, {shown_sql('month(d)')} AS month FROM ({DATES})")
def _(spark, sf):
    return _dates(spark, sf).select("id", shown(calendar.month_of(F.col("d"))).alias("month"))


QUARTER = shown_sql("'Q' || quarter(d)")


@query("quarter_of", f"SELECT id, {QUARTER} AS quarter FROM ({DATES})")
def _(spark, sf):
    return _dates(spark, sf).select("id", shown(calendar.quarter_of(F.col("d"))).alias("quarter"))


WEEK = "'Week' || coalesce(CAST(CAST(ceil(day(d) / 7.0) AS INTEGER) AS VARCHAR), 'NA')"


@query("week_of_month", f"SELECT id, {WEEK} AS week FROM ({DATES})")
def _(spark, sf):
    return _dates(spark, sf).select("id", calendar.week_of_month(F.col("d")).alias("week"))


ABBR = shown_sql("strftime(d, '%b')")


@query("month_abbr", f"SELECT id, {ABBR} AS month_abbr FROM ({DATES})")
def _(spark, sf):
    return _dates(spark, sf).select("id", shown(calendar.month_abbr(F.col("d"))).alias("month_abbr"))


# Codes with and without leading zeros, and missing ones.
PADDED = """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
    WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
    ELSE CAST(c_nationkey AS VARCHAR) END AS code FROM customer"""


@query("province_group", f"""SELECT id, {group_of('code')} AS stripped,
    CASE WHEN code IN ('7', '9', '18', '23') THEN 'Marine' ELSE 'Inland' END AS as_is FROM ({PADDED})""")
def _(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    bare = F.col("c_nationkey").cast("string")
    code = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).when(
        F.col("c_custkey") % 2 == 0, F.lpad(bare, 3, "0")
    ).otherwise(bare)
    return customer.select(
        F.col("c_custkey").alias("id"),
        answers.province_group(code).alias("stripped"),
        answers.province_group(code, zeros=False).alias("as_is"),
    )


@query("typed_measure", with_tables(
    "SELECT id, 0 AS pos, coalesce(TRY_CAST(caught AS DOUBLE), 0) AS catch FROM subs WHERE line < 6"
    " UNION ALL SELECT id, 1, 0 FROM subs WHERE line < 6",
    "subs",
))
def _(spark, sf):
    cleaned = clean.clean_capture(star.submissions(spark, sf))
    measure = F.coalesce(coercion.measure_of(cleaned, "nat_fishcatch_nat_catch"), F.lit(0.0))
    return cleaned.select("id", "pos", measure.alias("catch"))


@query("code_columns", with_tables("SELECT id, pos, area_code, fishing_type, fish_code FROM capture0", "capture0"))
def _(spark, sf):
    raw = star.capture(spark, sf)
    return raw.select(
        "id", "pos",
        typed.code_column(raw, "nat_fishcatch_area_nat").alias("area_code"),
        typed.code_column(raw, "nat_fishcatch_type_fishing").alias("fishing_type"),
        typed.code_column(raw, "nat_fishcatch_nat_fishtype").alias("fish_code"),
    )


@query("filter_amount_present", with_tables(
    "SELECT id, processing_amount AS amount FROM processing0 WHERE proc_code <> '3'", "processing0"
))
def _(spark, sf):
    answered = F.when(F.col("processing_typeprocessing") != "3", F.col("processing_amountprocessing"))
    rows = star.processing(spark, sf).select("id", answered.alias("amount"))
    return flt.filter_amount_present(rows, "amount")


@query("code_list", with_tables(
    "SELECT code AS fish_code, fish_name_kh, fish_name_en FROM fish", "fish"
))
def _(spark, sf):
    return lookups.code_list(star.choices(spark, sf), lookups.FISH_LIST)


@query("lookup_left_join", with_tables(
    f"""SELECT t.id, t.proc_code, {shown_sql('k.proc_name_kh')} AS proc_name_kh,
    {shown_sql('k.proc_name_en')} AS proc_name_en
    FROM processing0 t LEFT JOIN kinds k ON t.proc_code = k.code""",
    "processing0", "kinds",
))
def _(spark, sf):
    rows = typed.typed_processing(star.processing(spark, sf)).select("id", "proc_code")
    kinds = star.codebook(spark, sf).list(lookups.PROCESSED_LIST)
    joined = lookups.lookup_left_join(rows, kinds, "proc_code", "proc_code")
    labels = {c: shown(c) for c in ("proc_name_kh", "proc_name_en")}
    return joined.withColumns(labels)


@query("lookup_left_join__dealt", with_tables(
    """SELECT t.id, t.pos, t.fish_code, coalesce(f.fish_name_kh, t.fish_code) AS fish_name_kh,
    coalesce(f.fish_name_en, t.fish_code) AS fish_name_en FROM capture0 t LEFT JOIN fish f ON t.fish_code = f.code""",
    "capture0", "fish",
))
def _(spark, sf):
    """Catches and the species list kept in the same buckets, joined without a shuffle."""
    name = f"dealt_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    capture = typed.typed_capture(star.capture(spark, sf)).select("id", "pos", "fish_code")
    rows = dealt.deal_rows(capture, "fish_code", f"{name}_rows", f"{folder}/rows")
    fish = star.codebook(spark, sf).list(lookups.FISH_LIST)
    listed = dealt.deal_list(fish, "fish_code", f"{name}_list", f"{folder}/list")
    return dealt.label_dealt(rows, listed)


@query("lookup_left_join__repeated_code", with_tables(
    """SELECT t.province, coalesce(f.label, 'NA') AS label, count(*) AS n
    FROM processing0 t LEFT JOIN (SELECT CAST(n_regionkey AS VARCHAR) AS code, n_name AS label FROM nation) f
    ON t.province = f.code GROUP BY 1, 2""",
    "processing0",
))
def _(spark, sf):
    """Five labels per code: each row of such a code comes five times."""
    rows = star.processing(spark, sf).groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    nations = star.table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("code"), F.col("n_name").alias("label")
    )
    joined = lookups.lookup_left_join(rows, nations, "province", "code")
    return joined.select("province", shown("label").alias("label"), "n")


@query("label_fallback", with_tables(
    """SELECT id, coalesce(p.province_kh, t.province) AS province_kh,
    coalesce(p.province_en, t.province) AS province_en, t.province
    FROM patrol0 t LEFT JOIN provinces p ON t.province = p.code""",
    "patrol0", "provinces",
))
def _(spark, sf):
    rows = typed.typed_patrol(star.patrol(spark, sf)).select("id", "province")
    provinces = star.codebook(spark, sf).list(lookups.PROVINCE_LIST)
    return lookups.label_fallback(
        lookups.lookup_left_join(rows, provinces, "province", "province")
    )


def _shown_date(df):
    return df.withColumn("date", shown("date"))


PARTS = """t.id, CAST(t.date AS VARCHAR) AS date, t.year, t.month, t.quarter, t.week, t.province,
    t.province_group, t.province_kh, t.province_en"""


@query("enrich_submissions", with_tables(
    f"""SELECT s.id, CAST(s.date AS VARCHAR) AS date, s.year, s.month, s.quarter, s.week, s.province,
    CASE WHEN s.province IN ('7', '9', '18', '23') THEN 'Marine' ELSE 'Inland' END AS province_group,
    strftime(s.date, '%b') AS month_abbr, coalesce(p.province_kh, s.province) AS province_kh,
    coalesce(p.province_en, s.province) AS province_en
    FROM (SELECT id, {calendar_sql('CAST(date AS DATE)')}, CAST(CAST(province AS INTEGER) AS VARCHAR) AS province
        FROM subs) s LEFT JOIN provinces p ON s.province = p.code""",
    "subs", "provinces",
))
def _(spark, sf):
    main = clean.clean_main(star.submissions(spark, sf))
    return _shown_date(enrich.enrich_submissions(main, star.codebook(spark, sf)))


@query("enrich_capture", with_tables(
    f"""SELECT {PARTS}, t.pos, t.catch, t.area_code, t.fishing_type, t.fish_code, t.fish_name_kh,
    t.fish_name_en, t.area_kh, t.area_en FROM capture t""",
    "capture",
))
def _(spark, sf):
    return _shown_date(enrich.enrich_capture(star.capture(spark, sf), star.codebook(spark, sf)))


@query("enrich_aquaculture", with_tables(
    f"""SELECT {PARTS}, t.pos, t.catch, t.area_code, t.fish_code, {shown_sql('t.aqu_type')} AS aqu_type,
    t.fish_name_kh, t.fish_name_en, t.area_kh, t.area_en FROM aquf t""",
    "aquf",
))
def _(spark, sf):
    rows = enrich.enrich_aquaculture(star.aquaculture(spark, sf), star.codebook(spark, sf))
    return _shown_date(rows).withColumn("aqu_type", shown("aqu_type"))


@query("enrich_processing", with_tables(
    f"""SELECT {PARTS}, t.pos, t.processing_amount, t.proc_code, t.area_code, t.area_kh, t.area_en,
    t.proc_name_kh, t.proc_name_en FROM processing t""",
    "processing",
))
def _(spark, sf):
    return _shown_date(enrich.enrich_processing(star.processing(spark, sf), star.codebook(spark, sf)))


@query("enrich_patrol", with_tables(
    f"SELECT {PARTS}, t.pos, t.patrol_amountcrime, t.patrol_enforcement FROM patrol t", "patrol"
))
def _(spark, sf):
    return _shown_date(enrich.enrich_patrol(star.patrol(spark, sf), star.codebook(spark, sf)))


@query("combined_catch", with_tables(
    """SELECT year, month, quarter, province, coalesce(area_en, 'NA') AS area_en,
        coalesce(area_code, 'NA') AS area_code, area_group, sum(catch) AS catch, count(*) AS n
    FROM (SELECT year, month, quarter, catch, province_en AS province, area_en, area_code,
            CASE area_code WHEN '1' THEN 'Freshwater Capture' ELSE 'Marine Capture' END AS area_group
        FROM capture
        UNION ALL SELECT year, month, quarter, catch, province_kh, NULL, NULL, 'Aquaculture' FROM aqu)
    GROUP BY ALL""",
    "capture", "aqu",
))
def _(spark, sf):
    codes = star.codebook(spark, sf)
    both = enrich.combined_catch(
        enrich.enrich_capture(star.capture(spark, sf), codes),
        enrich.enrich_aquaculture(star.aquaculture(spark, sf), codes),
    )
    keys = ["year", "month", "quarter", "province", "area_en", "area_code", "area_group"]
    shown_keys = {c: shown(c) for c in ("area_en", "area_code")}
    return both.withColumns(shown_keys).groupBy(*keys).agg(
        F.sum("catch").alias("catch"), F.count(F.lit(1)).alias("n")
    )
