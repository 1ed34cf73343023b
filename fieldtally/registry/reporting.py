"""The eleven reports, each with at least one choice of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.operators import reshape
from fieldtally.operators.cleaning import ensure_columns
from fieldtally.operators.filters import Filters
from fieldtally.plans import reports as R
from fieldtally.registry.core import query
from fieldtally.registry.sql import group_of, texts, with_tables
from fieldtally.sources import star

WHOLE = "CAST(round_even(catch, 0) AS INTEGER)"


def province_years_sql(
    where: str, years: tuple[int, ...], domain: tuple[str, ...] | None, period: str = "TRUE"
) -> str:
    """Wide form: a row per province, a column per year."""
    sums = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN c.year = {y} THEN c.whole END), 0) AS BIGINT) AS \"{y}\""
        for y in years
    )
    rows = f"""SELECT province_kh, year, {WHOLE} AS whole FROM capture
        WHERE ({where}) AND ({period}) AND year IN ({', '.join(map(str, years))})"""
    if domain is None:
        body = f"SELECT c.province_kh, {sums} FROM c GROUP BY c.province_kh"
        return with_tables(body, "capture", c=rows)
    body = f"""SELECT d.province_kh, {sums} FROM d LEFT JOIN c ON c.province_kh = d.province_kh
        GROUP BY d.province_kh"""
    listed = f"SELECT unnest([{texts(domain)}]) AS province_kh"
    return with_tables(body, "capture", c=rows, d=listed)


def province_all_years_sql(where: str, domain: tuple[str, ...] | None, period: str = "TRUE") -> str:
    """Long form over all years: the years are taken before the period filter."""
    rows = f"SELECT province_kh, year, ({period}) AS inside, {WHOLE} AS whole FROM capture WHERE {where}"
    listed = (
        "SELECT DISTINCT province_kh FROM c WHERE inside"
        if domain is None
        else f"SELECT unnest([{texts(domain)}]) AS province_kh"
    )
    body = """SELECT d.province_kh, y.year, CAST(coalesce(sum(c.whole), 0) AS BIGINT) AS total_catch
        FROM d CROSS JOIN (SELECT DISTINCT year FROM c WHERE year IS NOT NULL) y
        LEFT JOIN c ON c.province_kh = d.province_kh AND c.year = y.year AND c.inside
        GROUP BY 1, 2"""
    return with_tables(body, "capture", c=rows, d=listed)


T05_ROWS = f"area_code = '2' AND province_kh <> '{D.EXCLUDED_FROM_MARINE}'"
T04_ROWS = "area_code = '1' AND fishing_type = '3'"
T03_ROWS = f"area_code = '1' AND fishing_type = '2' AND province_kh IN ({texts(D.PROVINCES)})"
T02_ROWS = f"area_code = '1' AND fishing_type = '1' AND province_kh IN ({texts(D.DAI_PROVINCES)})"
PAIR = (1997, 1998)
INLAND = "province_group = 'Inland' AND (area_code IN ('1', '01') OR regexp_matches(lower(area_en), 'fresh|inland'))"


@query("t04_rice_field__y1998_q1", province_years_sql(T04_ROWS, PAIR, D.PROVINCES, "quarter = 'Q1'"))
def _(spark, sf):
    return R.t04_rice_field(star.tables(spark, sf), Filters(year=1998, quarter="Q1"))


@query("t04_rice_field__all_years_week5", province_all_years_sql(T04_ROWS, D.PROVINCES, "week = 'Week5'"))
def _(spark, sf):
    return R.t04_rice_field(star.tables(spark, sf), Filters(week="Week5"), wide=False)


@query(
    "t04_rice_field__one_province",
    province_years_sql(f"{T04_ROWS} AND province_kh = '{D.PROVINCES[0]}'", PAIR, D.PROVINCES),
)
def _(spark, sf):
    chosen = Filters(year=1998, province=D.PROVINCES[0])
    return R.t04_rice_field(star.tables(spark, sf), chosen)


@query("t03_fishery_domain__y1998_q1", province_years_sql(T03_ROWS, PAIR, D.PROVINCES, "quarter = 'Q1'"))
def _(spark, sf):
    return R.t03_fishery_domain(star.tables(spark, sf), Filters(year=1998, quarter="Q1"))


@query(
    "t03_fishery_domain__inland_m7",
    province_years_sql(f"{T03_ROWS} AND {INLAND}", PAIR, D.PROVINCES, "month = 7"),
)
def _(spark, sf):
    return R.t03_fishery_domain(star.tables(spark, sf), Filters(group="Inland", year=1998, month=7))


@query("t02_dai__y1998_q1", province_years_sql(T02_ROWS, PAIR, D.DAI_PROVINCES, "quarter = 'Q1'"))
def _(spark, sf):
    return R.t02_dai(star.tables(spark, sf), Filters(year=1998, quarter="Q1"))


@query("t02_dai__all_years", province_all_years_sql(T02_ROWS, D.DAI_PROVINCES))
def _(spark, sf):
    return R.t02_dai(star.tables(spark, sf), wide=False)


@query("t05_marine_province__y1998_q1", province_years_sql(T05_ROWS, PAIR, None, "quarter = 'Q1'"))
def _(spark, sf):
    return R.t05_marine_province(star.tables(spark, sf), Filters(year=1998, quarter="Q1"))


@query(
    "t05_marine_province__all_years_m2",
    province_all_years_sql(f"{T05_ROWS} AND province_group = 'Marine' AND area_en = 'Marine'", None, "month = 2"),
)
def _(spark, sf):
    chosen = Filters(group="Marine", area="Marine", month=2)
    return R.t05_marine_province(star.tables(spark, sf), chosen, wide=False)


@query("t05_marine_province__missing_ids", province_years_sql(T05_ROWS, PAIR, None, "quarter = 'Q1'"))
def _(spark, sf):
    """The same provinces and sums where some submissions, or all of a province, have no id."""
    tables = star.tables(spark, sf)
    unnumbered = (F.col("id") % 3 == 0) | (F.col("province") % 2 == 0)
    capture = tables.capture.withColumn("id", F.when(~unnumbered, F.col("id")))
    cube = R.capture_cube(capture, Filters(year=1998, quarter="Q1"), ["province", "area_code"])
    return R.t05_marine_province(tables, Filters(year=1998, quarter="Q1"), cube)


def species_sql(where: str, top: int | None) -> str:
    cells = f"""SELECT fish_name_kh, province_kh, CAST(sum({WHOLE}) AS BIGINT) AS catch
        FROM capture WHERE {WHOLE} > 0 AND ({where}) GROUP BY 1, 2"""
    limit = "" if top is None else f"ORDER BY total DESC, fish_name_kh LIMIT {top}"
    totals = f"""SELECT fish_name_kh, CAST(sum(catch) AS BIGINT) AS total FROM cells
        GROUP BY fish_name_kh {limit}"""
    body = "SELECT fish_name_kh, province_kh, catch, total FROM cells JOIN totals USING (fish_name_kh)"
    return with_tables(body, "capture", cells=cells, totals=totals)


@query("t06_marine_species__y1998", species_sql(f"{T05_ROWS} AND year = 1998", D.TOP_SPECIES))
def _(spark, sf):
    return R.t06_marine_species(star.tables(spark, sf), Filters(year=1998), wide=False)


@query(
    "t06_marine_species__marine_q2_all_years",
    species_sql(f"{T05_ROWS} AND province_group = 'Marine' AND quarter = 'Q2'", D.TOP_SPECIES),
)
def _(spark, sf):
    chosen = Filters(group="Marine", quarter="Q2")
    return R.t06_marine_species(star.tables(spark, sf), chosen, wide=False)


@query("t06_species_detail__inland_y1998", species_sql(f"{INLAND} AND year = 1998", None))
def _(spark, sf):
    chosen = Filters(group="Inland", year=1998)
    return R.t06_species_detail(star.tables(spark, sf), chosen, wide=False)


#: Columns of the wide forms over the given tables: every province and the code without a label; every species code.
PROVINCE_COLUMNS = ("0", *D.PROVINCES)
SPECIES_COLUMNS = (*map(str, range(100)), *(f"FM{i:03}" for i in range(100)))


def species_wide_sql(where: str, top: int | None) -> str:
    """A column per province, and the total."""
    return f"""WITH
    wide AS (PIVOT ({species_sql(where, top)}) ON province_kh IN ({texts(PROVINCE_COLUMNS)})
        USING CAST(sum(catch) AS BIGINT) GROUP BY fish_name_kh, total)
    SELECT fish_name_kh, total AS "{D.TOTAL}", coalesce(columns(* EXCLUDE (fish_name_kh, total)), 0) FROM wide"""


@query("t06_marine_species__wide", species_wide_sql(f"{T05_ROWS} AND year = 1998", None))
def _(spark, sf):
    """All species, since a row beyond the first ones can hold a province no other has."""
    tables = star.tables(spark, sf)
    cells = R._species_cells(tables, Filters(year=1998), None, marine=True)
    return ensure_columns(R._species_wide(cells, None), PROVINCE_COLUMNS, F.lit(0).cast("long"))


@query("t06_species_detail__wide", species_wide_sql("year = 1998", None))
def _(spark, sf):
    wide = R.t06_species_detail(star.tables(spark, sf), Filters(year=1998))
    return ensure_columns(wide, PROVINCE_COLUMNS, F.lit(0).cast("long"))


def aquaculture_sql(where: str, detail: bool) -> str:
    sums = {label: f"fish_code = '{code}'" for code, label in D.SPECIES.items()}
    if detail:
        water = {D.FRESH_FISH: "area_code = '1'", D.SEA_FISH: "area_code = '2'"}
        sums = water | sums
    else:
        where += f" AND fish_code IN ({texts(D.SPECIES)})"
    inner = ", ".join(
        f"coalesce(sum(CASE WHEN {p} THEN catch END), 0) AS c{i}" for i, p in enumerate(sums.values())
    )
    label = "trim(province_kh)" if detail else "province_kh"
    rows = f"SELECT {label} AS province, {inner} FROM aqu WHERE catch > 0 AND {where} GROUP BY 1"
    out = [f'CAST(round_even(c{i}, 0) AS INTEGER) AS "{label}"' for i, label in enumerate(sums)]
    total = " + ".join(f"c{i}" for i in range(len(sums)))
    out.append(f'CAST(round_even({total}, 0) AS INTEGER) AS "{D.TOTAL}"')
    if detail:
        out.append("CAST(round_even(c0 + c1, 0) AS INTEGER) AS total_area")
    body = f'SELECT province AS "{D.PROVINCE_HEADING}", {", ".join(out)} FROM r'
    return with_tables(body, "aqu", r=rows)


@query("t07_aquaculture__y1998", aquaculture_sql("year IN (1997, 1998)", detail=False))
def _(spark, sf):
    return R.t07_aquaculture(star.tables(spark, sf), Filters(year=1998))


@query("t07_aquaculture__inland_q3", aquaculture_sql(f"quarter = 'Q3' AND {INLAND}", detail=False))
def _(spark, sf):
    return R.t07_aquaculture(star.tables(spark, sf), Filters(group="Inland", quarter="Q3"))


@query("t07_aquaculture_detail__y1998", aquaculture_sql("year IN (1997, 1998)", detail=True))
def _(spark, sf):
    return R.t07_aquaculture_detail(star.tables(spark, sf), Filters(year=1998))


def enforcement_sql(where: str, group: str | None = None) -> str:
    counts = ", ".join(
        f'CAST(count(*) FILTER (WHERE code = \'{c}\') AS BIGINT) AS "{label}"'
        for c, label in D.OUTCOMES.items()
    )
    codes = f"""SELECT province_kh, unnest(regexp_extract_all(patrol_enforcement, '[0-9]+')) AS code
        FROM patrol WHERE {where}"""
    offered = "SELECT province_kh FROM provinces"
    if group is not None:
        offered += f" WHERE {group_of('code')} = '{group}'"
    everywhere = " UNION ".join(f"SELECT province_kh FROM {t}" for t in ("capture", "aqu", "processing", "patrol"))
    if group is not None:
        everywhere = f"SELECT * FROM ({everywhere}) WHERE province_kh IN ({offered})"
    shown = f"""{everywhere} UNION SELECT province_kh FROM codes
        WHERE code IN ({texts(D.OUTCOMES)})"""
    body = f"""SELECT s.province_kh, {counts} FROM s LEFT JOIN codes USING (province_kh)
        GROUP BY s.province_kh"""
    return with_tables(body, "capture", "aqu", "processing", "patrol", codes=codes, s=shown)


@query("t08_enforcement", enforcement_sql("TRUE"))
def _(spark, sf):
    return R.t08_enforcement(star.tables(spark, sf))


@query(
    "t08_enforcement__marine_y2024_week2",
    enforcement_sql("province_group = 'Marine' AND year IN (2023, 2024) AND week = 'Week2'", "Marine"),
)
def _(spark, sf):
    chosen = Filters(group="Marine", year=2024, week="Week2")
    return R.t08_enforcement(star.tables(spark, sf), chosen)


WORDS = r"string_split(trim(regexp_replace(lower(aqu_type), '[_\-\s]+', ' ', 'g')), ' ')"


def has_facility_sql(kind: str) -> str:
    return f"coalesce(list_has_any({WORDS}, [{texts(D.FACILITIES[kind])}]), FALSE)"


def facilities_sql(where: str, all_provinces: bool) -> str:
    flags = ", ".join(
        f"CAST({has_facility_sql(kind)} AS INTEGER) AS f{i}" for i, kind in enumerate(D.FACILITIES)
    )
    rows = f"SELECT province_kh, {flags} FROM aqu WHERE {where}"
    zeros = f"UNION ALL SELECT unnest([{texts(D.PROVINCES)}]), 0, 0, 0" if all_provinces else ""
    sums = ", ".join(
        f'CAST(sum(f{i}) AS BIGINT) AS "{kind}"' for i, kind in enumerate(D.FACILITIES)
    )
    body = f"""SELECT province_kh, {sums}
        FROM (SELECT * FROM r WHERE f0 + f1 + f2 > 0 {zeros}) GROUP BY province_kh"""
    return with_tables(body, "aqu", r=rows)


@query("t10_facilities__y1998", facilities_sql("year IN (1997, 1998)", True))
def _(spark, sf):
    return R.t10_facilities(star.tables(spark, sf), Filters(year=1998))


@query(
    "t10_facilities__one_province",
    facilities_sql(f"province_kh = '{D.PROVINCES[6]}' AND area_en = 'Marine'", False),
)
def _(spark, sf):
    chosen = Filters(province=D.PROVINCES[6], area="Marine")
    return R.t10_facilities(star.tables(spark, sf), chosen)


CODE_SUMMARY = with_tables(
    """SELECT row_num, province_kh, fish_code, total, total_sum
    FROM cells JOIN ranked USING (province_kh)""",
    "aqu",
    cells="""SELECT province_kh, fish_code, sum(catch) AS total FROM aqu WHERE catch > 0
        GROUP BY 1, 2""",
    ranked="""SELECT province_kh, sum(total) AS total_sum,
        CAST(row_number() OVER (ORDER BY sum(total) DESC, province_kh) AS INTEGER) AS row_num
        FROM cells GROUP BY province_kh""",
)


@query("aqu_code_summary__wide", f"""WITH
    wide AS (PIVOT ({CODE_SUMMARY}) ON fish_code IN ({texts(SPECIES_COLUMNS)}) USING sum(total) GROUP BY row_num, province_kh, total_sum)
    SELECT row_num AS "{D.ROW_NUMBER_HEADING}", province_kh AS "{D.PROVINCE_OR_CAPITAL}", total_sum AS "{D.TOTAL}",
        coalesce(columns(* EXCLUDE (row_num, province_kh, total_sum)), 0) FROM wide""")
def _(spark, sf):
    return ensure_columns(R.aqu_code_summary(star.tables(spark, sf)), SPECIES_COLUMNS, F.lit(0.0))


@query("aqu_code_summary", CODE_SUMMARY)
def _(spark, sf):
    return R.aqu_code_summary(star.tables(spark, sf), wide=False)


def shown_map(df: DataFrame, cells: str, number: str) -> DataFrame:
    """A map as text, ``column=value`` in order."""
    entries = F.transform(F.map_entries(cells), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast(number).cast("string")))
    return df.withColumn(cells, F.concat_ws(";", entries))


@query("t06_species_detail__map", f"""SELECT fish_name_kh,
    string_agg(province_kh || '=' || CAST(catch AS VARCHAR), ';' ORDER BY province_kh) AS cells, any_value(total) AS total
    FROM ({species_sql("year = 1998", None)}) GROUP BY fish_name_kh""")
def _(spark, sf):
    """A map from province to catch."""
    return shown_map(R.t06_species_detail(star.tables(spark, sf), Filters(year=1998), wide=R.MAP), "cells", "long")


@query("aqu_code_summary__map", f"""SELECT row_num, province_kh,
    string_agg(fish_code || '=' || CAST(CAST(total * 2 AS BIGINT) AS VARCHAR), ';' ORDER BY fish_code) AS cells, any_value(total_sum) AS total_sum
    FROM ({CODE_SUMMARY}) GROUP BY row_num, province_kh""")
def _(spark, sf):
    """A map from species code to catch, in halves."""
    summary = R.aqu_code_summary(star.tables(spark, sf), wide=R.MAP)
    doubled = summary.withColumn("cells", F.transform_values("cells", lambda _, v: v * 2))
    return shown_map(doubled, "cells", "long")


@query("pivot_map__many_columns", with_tables(
    """SELECT province, count(*) AS n_columns, CAST(sum(whole) AS BIGINT) AS total, min(fish) AS first_column, max(fish) AS last_column
    FROM (SELECT province, fish, sum(whole) AS whole FROM (
        SELECT province, CAST(id AS VARCHAR) || ':' || fish_code AS fish, CAST(round_even(catch, 0) AS BIGINT) AS whole FROM capture0)
        GROUP BY 1, 2) GROUP BY province""",
    "capture0",
))
def _(spark, sf):
    """Thousands of columns, one for each order and species."""
    capture = star.tables(spark, sf).capture
    rows = capture.select("province", F.concat(F.col("id").cast("string"), F.lit(":"), "fish_code").alias("fish"), F.rint("catch").cast("long").alias("whole"))
    wide = reshape.pivot_map(rows, ["province"], "fish", "whole")
    columns = F.map_keys("cells")
    return wide.select("province", F.size("cells").cast("long").alias("n_columns"), "total", F.array_min(columns).alias("first_column"), F.array_max(columns).alias("last_column"))
