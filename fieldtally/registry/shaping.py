"""Sums, cross-tabs, zero rows, order and the explosion of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import answers, coercion
from fieldtally.operators import filters as flt
from fieldtally.operators import reshape
from fieldtally.operators.cleaning import ensure_columns, resolve_column
from fieldtally.operators.repeats import explode_codes, explode_facilities
from fieldtally.plans import typed
from fieldtally.registry.core import query, shown
from fieldtally.registry.reporting import WHOLE, WORDS, has_facility_sql
from fieldtally.registry.sql import texts, with_tables
from fieldtally.sources import star

TYPES = ("1", "2", "3")


def _capture(spark, sf):
    rows = typed.typed_capture(star.capture(spark, sf))
    return rows.withColumn("catch", coercion.rounded(F.col("catch")))


def _aquaculture(spark, sf):
    return typed.typed_aquaculture(star.aquaculture(spark, sf))


def _by_province(spark, sf):
    """Rounded catch by province code, as a small table to shape further."""
    return reshape.group_sum(_capture(spark, sf), ["province"], "catch", "total")


SUMS = f"SELECT province, CAST(sum({WHOLE}) AS BIGINT) AS total FROM capture0 GROUP BY province"


@query("group_sum", with_tables(
    f"SELECT province, year, CAST(sum({WHOLE}) AS BIGINT) AS total FROM capture0 GROUP BY 1, 2",
    "capture0",
))
def _(spark, sf):
    return reshape.group_sum(_capture(spark, sf), ["province", "year"], "catch", "total")


@query("group_count", with_tables(
    "SELECT province, patrol_enforcement, count(*) AS total FROM patrol0 GROUP BY 1, 2", "patrol0"
))
def _(spark, sf):
    patrol = typed.typed_patrol(star.patrol(spark, sf))
    return reshape.group_count(patrol, ["province", "patrol_enforcement"])


@query("conditional_sum", with_tables(
    """SELECT province, coalesce(sum(CASE WHEN area_code = '1' THEN catch END), 0) AS fresh,
    coalesce(sum(CASE WHEN area_code = '2' THEN catch END), 0) AS sea FROM aqu0 GROUP BY 1""",
    "aqu0",
))
def _(spark, sf):
    waters = {"fresh": F.col("area_code") == "1", "sea": F.col("area_code") == "2"}
    return reshape.conditional_sum(_aquaculture(spark, sf), ["province"], F.col("catch"), waters)


@query("multi_column_sum", """SELECT l_returnflag, sum(l_quantity) AS l_quantity,
    CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1""")
def _(spark, sf):
    items = star.table(spark, sf, "lineitem")
    return reshape.multi_column_sum(items, ["l_returnflag"], ["l_quantity", "l_linenumber"])


def wide_sql(column: str, values) -> str:
    sums = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {column} = '{v}' THEN {WHOLE} END), 0) AS BIGINT) AS \"{v}\""
        for v in values
    )
    return with_tables(f"SELECT province, {sums} FROM capture0 GROUP BY province", "capture0")


@query("pivot_wide", wide_sql("fishing_type", TYPES))
def _(spark, sf):
    return reshape.pivot_wide(_capture(spark, sf), ["province"], "fishing_type", "catch", TYPES)


@query("pivot_wide__columns_from_data", wide_sql("area_code", ("1", "2")))
def _(spark, sf):
    return reshape.pivot_wide(_capture(spark, sf), ["province"], "area_code", "catch")


@query("ensure_pivot_columns", wide_sql("fishing_type", (*TYPES, "9")))
def _(spark, sf):
    table = reshape.pivot_wide(_capture(spark, sf), ["province"], "fishing_type", "catch", TYPES)
    return ensure_columns(table, ["1", "9"], F.lit(0).cast("long"))


@query("target_years", with_tables(
    "SELECT DISTINCT year FROM capture WHERE province_group = 'Marine' AND area_code = '2'", "capture"
))
def _(spark, sf):
    rows = flt.filter_group_only(_capture(spark, sf), "Marine").where("area_code = '2'")
    years = reshape.target_years(rows, None)
    return spark.createDataFrame([(y,) for y in years], "year int")


@query("observed_domain", with_tables(
    "SELECT DISTINCT province FROM capture0 WHERE year = 1998 AND month = 2", "capture0"
))
def _(spark, sf):
    rows = flt.filter_month(flt.filter_year_exact(_capture(spark, sf), 1998), 2)
    return reshape.observed_domain(rows, "province")


CODES = tuple(str(n) for n in range(1, 41))
DOMAIN = f"SELECT unnest([{texts(CODES)}]) AS province"


@query("missing_keys", with_tables(
    f"SELECT province FROM ({DOMAIN}) WHERE province NOT IN (SELECT province FROM capture0)", "capture0"
))
def _(spark, sf):
    domain = reshape.domain_frame(spark, CODES, "province").select("province")
    return reshape.missing_keys(domain, _by_province(spark, sf), "province")


@query("append_zero_rows", with_tables(
    """SELECT province, total FROM sums UNION ALL
    SELECT province, 0 FROM d WHERE province NOT IN (SELECT province FROM sums)""",
    "capture0", sums=SUMS, d=DOMAIN,
))
def _(spark, sf):
    domain = reshape.domain_frame(spark, CODES, "province")
    return reshape.append_zero_rows(_by_province(spark, sf), domain, "province")


@query("zero_fill_grid", with_tables(
    """SELECT d.province, y.year, CAST(coalesce(sum(c.catch), 0) AS BIGINT) AS catch
    FROM d CROSS JOIN (SELECT DISTINCT year FROM capture0) y
    LEFT JOIN c ON c.province = d.province AND c.year = y.year GROUP BY 1, 2""",
    "capture0",
    d=DOMAIN,
    c=f"SELECT province, year, {WHOLE} AS catch FROM capture0 WHERE fishing_type = '3'",
))
def _(spark, sf):
    rows = flt.filter_codes(_capture(spark, sf), fishing_type="3")
    cells = reshape.group_sum(rows, ["province", "year"], "catch", "catch")
    return reshape.zero_fill_grid(cells, "province", "year", "catch", CODES)


@query("zero_fill_grid__given_years", with_tables(
    """SELECT d.province, y.year, CAST(coalesce(sum(c.catch), 0) AS BIGINT) AS catch
    FROM d CROSS JOIN (SELECT CAST(unnest([1990, 1998]) AS INTEGER) AS year) y
    LEFT JOIN c ON c.province = d.province AND c.year = y.year GROUP BY 1, 2""",
    "capture0",
    d=DOMAIN,
    c=f"SELECT province, year, {WHOLE} AS catch FROM capture0",
))
def _(spark, sf):
    cells = reshape.group_sum(_capture(spark, sf), ["province", "year"], "catch", "catch")
    return reshape.zero_fill_grid(cells, "province", "year", "catch", CODES, [1990, 1998])


@query("merge_summaries", with_tables(
    """SELECT a.province, a.year, a.total, coalesce(b.farmed, 0) AS farmed
    FROM (SELECT province, year, count(*) AS total FROM capture0 GROUP BY 1, 2) a
    LEFT JOIN (SELECT province, year, count(*) AS farmed FROM aqu0 WHERE catch > 23 AND month = 1
        GROUP BY 1, 2) b ON a.province = b.province AND a.year = b.year""",
    "capture0", "aqu0",
))
def _(spark, sf):
    keys = ["province", "year"]
    caught = reshape.group_count(_capture(spark, sf), keys)
    grown = flt.filter_month(_aquaculture(spark, sf).where("catch > 23"), 1)
    return reshape.merge_summaries(caught, reshape.group_count(grown, keys, "farmed"), keys)


def _wide(spark, sf):
    return reshape.pivot_wide(_capture(spark, sf), ["province"], "fishing_type", "catch", TYPES)


WIDE_TOTAL = (
    f"SELECT *, \"1\" + \"2\" + \"3\" AS total FROM ({wide_sql('fishing_type', TYPES)})"
)


@query("row_total", WIDE_TOTAL)
def _(spark, sf):
    return reshape.row_total(_wide(spark, sf), TYPES, "total")


@query("round_outputs", with_tables(
    """SELECT province, CAST(round_even(sum(catch), 0) AS INTEGER) AS catch FROM aqu0
    WHERE area_code = '1' GROUP BY province""",
    "aqu0",
))
def _(spark, sf):
    fresh = flt.filter_codes(_aquaculture(spark, sf), area_code="1")
    sums = reshape.group_sum(fresh, ["province"], "catch", "catch")
    return reshape.round_outputs(sums, ["catch"])


def _placed(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with their places in it, of a few rows."""
    numbered = ordered.withColumn("__row", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("__row"))
    return numbered.withColumn("place", place).drop("__row")


@query("sort_desc_total", with_tables(
    f"SELECT *, CAST(row_number() OVER (ORDER BY total DESC, province) AS INTEGER) AS place FROM ({SUMS})",
    "capture0",
))
def _(spark, sf):
    return _placed(reshape.sort_desc_total(_by_province(spark, sf), "province", "total"))


@query("sort_by_domain", with_tables(
    f"""SELECT *, CAST(row_number() OVER (ORDER BY list_position([{texts(CODES)}], province) NULLS LAST, province)
    AS INTEGER) AS place FROM ({SUMS})""",
    "capture0",
))
def _(spark, sf):
    return _placed(reshape.sort_by_domain(_by_province(spark, sf), "province", CODES))


SPECIES_SUMS = f"SELECT fish_code, CAST(sum({WHOLE}) AS BIGINT) AS total FROM capture0 GROUP BY 1"


@query("top_k", with_tables(
    f"{SPECIES_SUMS} ORDER BY total DESC, fish_code LIMIT 51", "capture0"
))
def _(spark, sf):
    sums = reshape.group_sum(_capture(spark, sf), ["fish_code"], "catch", "total")
    return reshape.top_k(sums, "fish_code", "total")


@query("row_number", with_tables(
    """SELECT province, total,
    CAST(row_number() OVER (ORDER BY total DESC, province) AS INTEGER) AS row_num FROM sums""",
    "capture0", sums=SUMS,
))
def _(spark, sf):
    return reshape.row_number(_by_province(spark, sf), "province", "total", "row_num")


@query("select_rename", with_tables(
    f'SELECT province AS "{D.PROVINCE_HEADING}", total AS "{D.TOTAL}" FROM sums', "capture0", sums=SUMS
))
def _(spark, sf):
    named = {"province": D.PROVINCE_HEADING, "total": D.TOTAL}
    return reshape.select_rename(_by_province(spark, sf), named)


@query("trim_key", with_tables(
    "SELECT trim(aqu_type) AS kind, count(*) AS n FROM aqu0 WHERE aqu_type <> '' GROUP BY 1", "aqu0"
))
def _(spark, sf):
    """Labels with blanks, tabs and line ends around them."""
    rows = _aquaculture(spark, sf).where("aqu_type <> ''")
    around = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("\t "), "aqu_type", F.lit("\r\n"))).otherwise(F.col("aqu_type"))
    return reshape.group_count(rows, [answers.trimmed(around).alias("kind")], "n")


@query("empty_safe", with_tables(SUMS.replace("GROUP BY", "WHERE year = 1900 GROUP BY"), "capture0"))
def _(spark, sf):
    none = flt.filter_year_exact(_capture(spark, sf), 1900)
    return reshape.group_sum(none, ["province"], "catch", "total")


@query("resolve_column", with_tables("SELECT id, pos, coalesce(aqu_type, 'NA') AS kind FROM aqu0", "aqu0"))
def _(spark, sf):
    raw = star.aquaculture(spark, sf)
    found = resolve_column(raw, ["aqu_type", *typed.TYPE_COLUMNS])
    return raw.select("id", "pos", shown(found).alias("kind"))


# --- codes and types -------------------------------------------------------------------------

EXPLODED = "SELECT id, unnest(regexp_extract_all(patrol_enforcement, '[0-9]+')) AS code FROM patrol0"


@query("explode_codes", with_tables(
    "SELECT id, code FROM x WHERE code IN ('2', '3', '6')", "patrol0", x=EXPLODED
))
def _(spark, sf):
    patrol = typed.typed_patrol(star.patrol(spark, sf))
    rows = explode_codes(patrol, "patrol_enforcement", "code", D.OUTCOMES)
    return rows.select("id", "code")


RECODED = " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in D.OUTCOMES.items())


@query("recode", with_tables(
    f"SELECT coalesce(CASE code {RECODED} END, 'NA') AS label, count(*) AS n FROM x GROUP BY 1",
    "patrol0", x=EXPLODED,
))
def _(spark, sf):
    patrol = typed.typed_patrol(star.patrol(spark, sf))
    rows = explode_codes(patrol, "patrol_enforcement", "code")
    label = shown(answers.recode(F.col("code"), D.OUTCOMES)).alias("label")
    return reshape.group_count(rows, [label], "n")


NAMED = " || ',' || ".join(
    f"CASE WHEN {has_facility_sql(kind)} THEN '{kind}' ELSE '' END" for kind in D.FACILITIES
)


@query("normalize_types", with_tables(
    f"SELECT id, pos, trim(replace({NAMED}, ',,', ','), ',') AS kinds FROM aqu0", "aqu0"
))
def _(spark, sf):
    kinds = F.concat_ws(",", answers.facilities_in(F.col("aqu_type")))
    return _aquaculture(spark, sf).select("id", "pos", kinds.alias("kinds"))


@query("explode_types", with_tables(
    " UNION ALL ".join(
        f"SELECT province, '{kind}' AS type, count(*) AS n FROM aqu0"
        f" WHERE {has_facility_sql(kind)} GROUP BY 1"
        for kind in D.FACILITIES
    ),
    "aqu0",
))
def _(spark, sf):
    rows = explode_facilities(_aquaculture(spark, sf), "aqu_type", "type")
    return reshape.group_count(rows, ["province", "type"], "n")


@query("facility_words", with_tables(
    f"SELECT id, pos, coalesce(array_to_string({WORDS}, '|'), 'NA') AS words FROM aqu0", "aqu0"
))
def _(spark, sf):
    words = answers.facility_words(F.col("aqu_type"))
    return _aquaculture(spark, sf).select(
        "id", "pos", shown(F.array_join(words, "|")).alias("words")
    )
