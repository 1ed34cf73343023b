"""The eleven report queries.

Every report first sums the typed rows by their codes (a *cube*: partial sums on the map side,
one shuffle of one row per code combination), and joins code lists and applies label filters
after that.  Sums are the same either way, since a code list multiplies all rows of a code
alike.  So data rows are never joined, sorted or shuffled, however large a code list or however
uneven the codes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally import domains as D
from fieldtally.functions import answers, coercion
from fieldtally.operators import filters as flt
from fieldtally.operators import reshape
from fieldtally.operators.filters import ALL, Filters
from fieldtally.operators.lookups import AREA_LIST, FISH_LIST, LABELS, PROVINCE_LIST, Codebook
from fieldtally.operators.repeats import explode_codes
from fieldtally.plans.cells import ROWS, is_cells
from fieldtally.plans.options import province_labels, provinces_for_group
from fieldtally.plans.typed import SurveyTables
from fieldtally.session import settle


#: The wide form with a map in place of columns.
MAP = "map"


def _lists(filters: Filters, codes: Codebook, *shown: str) -> list[str]:
    """The lists to join: those shown or filtered by, and those that multiply rows."""
    wanted = [PROVINCE_LIST, *shown]
    if filters.needs_area_label:
        wanted.append(AREA_LIST)
    return wanted + [n for n in (FISH_LIST, AREA_LIST) if n in codes.repeated and n not in wanted]


def _keys(lists: Sequence[str]) -> list[str]:
    return [LABELS[name][0] for name in lists]


def _labelled(cube: DataFrame, codes: Codebook, lists: Sequence[str]) -> DataFrame:
    grouped = cube.withColumn("province_group", answers.province_group(F.col("province")))
    return codes.label(grouped, *lists)


# --- capture ---------------------------------------------------------------------------------


def capture_cube(
    capture: DataFrame, filters: Filters, keys: Sequence[str], pair: bool = True
) -> DataFrame:
    """Rounded catch by codes and year; ``pair`` takes in the year before.

    ``catch`` and ``positive`` count rows of the chosen quarter, month and week only.  A report
    over all years shows every year there is, so the other rows then stay in, as years without
    a sum.  ``first_id`` is the first submission of the period, ``rows`` the number of its rows.
    """
    by_year = flt.filter_year_pair if pair else flt.filter_year_exact
    rows = by_year(capture, filters.year)
    inside = flt.in_period(filters, years=_years(filters, pair))
    if filters.year is not None or not pair:
        rows, inside = rows.where(inside), F.lit(True)
    by_code = rows.groupBy(*dict.fromkeys([*keys, "year"]))
    if is_cells(capture):
        return by_code.agg(
            F.sum(F.when(inside, F.col("catch"))).alias("catch"),
            F.sum(F.when(inside, F.col("positive"))).alias("positive"),
            F.min(F.when(inside, F.col("first_id"))).alias("first_id"),
            F.sum(F.when(inside, F.col(ROWS)).otherwise(0)).alias("rows"),
        )
    whole = coercion.rounded(F.col("catch"))
    return by_code.agg(
        F.sum(F.when(inside, whole)).alias("catch"),
        F.sum(F.when(inside & (whole > 0), whole)).alias("positive"),
        F.min(F.when(inside, F.col("id"))).alias("first_id"),
        F.count_if(inside).alias("rows"),
    )


def _years(filters: Filters, pair: bool = True) -> tuple[int, ...] | None:
    """The years a filter leaves, if it names one."""
    if filters.year is None:
        return None
    return (filters.year - 1, filters.year) if pair else (filters.year,)


def _species_cells(
    tables: SurveyTables, filters: Filters, cube: DataFrame | None, marine: bool
) -> DataFrame:
    """Positive catch by species and province labels."""
    lists = _lists(filters, tables.codes, FISH_LIST)
    if cube is None:
        rows = tables.capture_cells
        if not is_cells(rows):
            rows = flt.filter_positive_rounded(rows, "catch")
        keys = dict.fromkeys([*_keys(lists), "area_code"] if marine else _keys(lists))
        cube = capture_cube(rows, filters, list(keys), pair=False)
    rows = cube.where(F.col("positive").isNotNull() & F.col("year").isNotNull())
    if filters.year is not None:
        rows = rows.where(F.col("year") == filters.year)
    if marine:
        rows = flt.filter_codes(rows, area_code=D.AREA_MARINE)
    rows = _labelled(rows, tables.codes, lists)
    if marine:
        rows = flt.filter_not_equal(rows, "province_kh", D.EXCLUDED_FROM_MARINE)
    rows = flt.apply_labels(rows, filters)
    return reshape.group_sum(rows, ["fish_name_kh", "province_kh"], "positive", "catch")


def _species_wide(cells: DataFrame, top: int | None) -> DataFrame:
    """A column per province, in the order the sorted species first show them.

    More provinces than ``spark.sql.pivotMaxValues`` are an error; the long form has no such limit.
    """
    named = settle(cells.withColumn("province_kh", F.coalesce("province_kh", F.lit("NA"))))
    first_shown = [F.min("fish_name_kh"), F.bool_and(F.col("province_kh") == "NA")]
    columns = reshape.column_values(named, "province_kh", first_shown)
    wide = reshape.pivot_cells(named, ["fish_name_kh"], "province_kh", "catch", columns)
    wide = reshape.row_total(wide, columns)
    if top is None:
        return reshape.sort_desc_total(wide, "fish_name_kh")
    return reshape.top_k(wide, "fish_name_kh", k=top)


def _species_map(cells: DataFrame) -> DataFrame:
    """A map from province to catch in each species' row, and the total."""
    return reshape.pivot_map(cells, ["fish_name_kh"], "province_kh", "catch")


def _by_total(cells: DataFrame) -> DataFrame:
    order = reshape.by_total("fish_name_kh", "total")
    return cells.orderBy(*order, F.col("province_kh").asc_nulls_last())


def t06_marine_species(
    tables: SurveyTables, filters: Filters = ALL, cube: DataFrame | None = None, wide: bool | str = True
) -> DataFrame:
    """Marine catch by species and province, the 51 species of most catch.

    Wide with a column by province, or with ``wide="map"`` a map from province to catch, else long.
    """
    cells = _species_cells(tables, filters, cube, marine=True)
    if wide == MAP:
        return reshape.top_k(_species_map(cells), "fish_name_kh", "total")
    if wide:
        return _species_wide(cells, D.TOP_SPECIES)
    totals = reshape.group_sum(cells, ["fish_name_kh"], "catch", "total")
    top = reshape.top_k(totals, "fish_name_kh", "total")
    top = top.withColumnRenamed("fish_name_kh", "__fish")
    # at most 51 rows
    kept = cells.join(F.broadcast(top), F.col("fish_name_kh").eqNullSafe(F.col("__fish")))
    return _by_total(kept.drop("__fish"))


def t06_species_detail(
    tables: SurveyTables, filters: Filters = ALL, cube: DataFrame | None = None, wide: bool | str = True
) -> DataFrame:
    """Catch of any area by species and province, all species; forms as of `t06_marine_species`."""
    cells = _species_cells(tables, filters, cube, marine=False)
    if wide == MAP:
        return reshape.sort_desc_total(_species_map(cells), "fish_name_kh", "total")
    if wide:
        return _species_wide(cells, None)
    # a species has at most as many cells as there are provinces
    species = Window.partitionBy("fish_name_kh")
    return _by_total(cells.withColumn("total", F.sum("catch").over(species)))


@dataclass(frozen=True)
class ProvinceYears:
    """A report of provinces by years: which rows of capture count, which provinces show.

    ``provinces`` are the rows of the result, in order, filled with zeros; ``None`` shows the
    provinces that have rows.  ``restrict`` drops other provinces' rows before the years of the
    report are taken.
    """

    area: str
    fishing_type: str | None = None
    provinces: tuple[str, ...] | None = None
    restrict: bool = False
    without: str | None = None


T05 = ProvinceYears(D.AREA_MARINE, without=D.EXCLUDED_FROM_MARINE)
T04 = ProvinceYears(D.AREA_FRESH, D.TYPE_RICE_FIELD, D.PROVINCES)
T03 = ProvinceYears(D.AREA_FRESH, D.TYPE_DOMAIN, D.PROVINCES, restrict=True)
T02 = ProvinceYears(D.AREA_FRESH, D.TYPE_DAI, D.DAI_PROVINCES, restrict=True)


def province_years(
    spec: ProvinceYears,
    tables: SurveyTables,
    filters: Filters = ALL,
    cube: DataFrame | None = None,
    wide: bool = True,
) -> DataFrame:
    lists = _lists(filters, tables.codes)
    if cube is None:
        keys = [*_keys(lists), "area_code"] + (["fishing_type"] if spec.fishing_type else [])
        cube = capture_cube(tables.capture_cells, filters, keys)
    rows = flt.filter_codes(cube, area_code=spec.area, fishing_type=spec.fishing_type)
    rows = _labelled(rows, tables.codes, lists)
    if spec.without is not None:
        rows = flt.filter_not_equal(rows, "province_kh", spec.without)
    if spec.restrict:
        rows = flt.filter_in_list(rows, "province_kh", spec.provinces)
    rows = flt.apply_labels(rows, filters).select("province_kh", "year", "catch", "first_id", "rows")
    if filters.year is None:
        by_label = rows.groupBy("province_kh", "year")
        rows = settle(
            by_label.agg(F.sum("catch").alias("catch"), F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"))
        )
    years = reshape.target_years(rows, filters.year)
    if spec.provinces is not None:
        rows = flt.filter_in_list(rows, "province_kh", spec.provinces)
        zeros = reshape.domain_frame(rows.sparkSession, spec.provinces, "province_kh")
        rows = rows.unionByName(zeros.select("province_kh"), allowMissingColumns=True)
    else:
        rows = rows.where(F.col("rows") > 0)
    sums = [
        reshape.sum_or_zero(F.when(F.col("year") == y, F.col("catch"))).alias(str(y))
        for y in years
    ]
    table = rows.groupBy("province_kh").agg(*sums, F.min("first_id").alias("first_id"))
    return _ordered(table, spec, [str(y) for y in years], wide)


def _ordered(
    table: DataFrame, spec: ProvinceYears, years: list[str], wide: bool
) -> DataFrame:
    """List order, or the order of first appearance; long form has a row per year."""
    if spec.provinces is None:
        place = F.struct(F.col("first_id").isNull().alias("unnumbered"), "first_id", "province_kh")
    else:
        place = answers.position_in(F.col("province_kh"), spec.provinces)
    table = table.withColumn("__place", place)
    if wide:
        return table.orderBy("__place").select("province_kh", *[f"`{y}`" for y in years])
    if not years:
        empty = table.where(F.lit(False))
        return empty.select(
            "province_kh", F.lit(0).alias("year"), F.lit(0).cast("long").alias("total_catch")
        )
    long = table.unpivot(["province_kh", "__place"], [f"`{y}`" for y in years], "year", "total_catch")
    long = long.withColumn("year", F.col("year").cast("int")).orderBy("__place", "year")
    return long.select("province_kh", "year", "total_catch")


def t05_marine_province(tables, filters=ALL, cube=None, wide=True) -> DataFrame:
    """Marine catch by province, year against the year before."""
    return province_years(T05, tables, filters, cube, wide)


def t04_rice_field(tables, filters=ALL, cube=None, wide=True) -> DataFrame:
    """Rice-field catch of all 25 provinces, year against the year before."""
    return province_years(T04, tables, filters, cube, wide)


def t03_fishery_domain(tables, filters=ALL, cube=None, wide=True) -> DataFrame:
    """Fishery-domain catch of all 25 provinces, year against the year before."""
    return province_years(T03, tables, filters, cube, wide)


def t02_dai(tables, filters=ALL, cube=None, wide=True) -> DataFrame:
    """Dai catch of the three dai provinces, year against the year before."""
    return province_years(T02, tables, filters, cube, wide)


# --- aquaculture -----------------------------------------------------------------------------


def aquaculture_cube(
    aquaculture: DataFrame, filters: Filters, keys: Sequence[str], only: Column | None = None
) -> DataFrame:
    """Positive catch, in all and of each species, and facility counts, by codes.

    ``grown`` and ``farmed`` count the rows with a catch, and those of the listed species.
    """
    rows = flt.filter_year_pair(aquaculture, filters.year).where(flt.in_period(filters, years=_years(filters)))
    if only is not None:
        rows = rows.where(only)
    if is_cells(aquaculture):
        of_species = [F.sum(F.when(F.col("fish_code") == code, F.col("catch"))).alias(label) for code, label in D.SPECIES.items()]
        kinds = [F.sum(F.col(f"`{kind}`")).alias(kind) for kind in D.FACILITIES if kind in aquaculture.columns]
        farmed = F.sum(F.when(F.col("fish_code").isin(*D.SPECIES), F.col("grown")).otherwise(0)).alias("farmed")
        return rows.groupBy(*keys).agg(*of_species, F.sum("catch").alias("catch"), *kinds, F.sum("grown").alias("grown"), farmed)
    grown = coercion.present(F.col("catch")) > 0
    listed = grown & F.col("fish_code").isin(*D.SPECIES)
    sums = [
        F.sum(F.when(grown & (F.col("fish_code") == code), F.col("catch"))).alias(label)
        for code, label in D.SPECIES.items()
    ]
    sums.append(F.sum(F.when(grown, F.col("catch"))).alias("catch"))
    if "aqu_type" in aquaculture.columns:
        sums += [
            F.count_if(answers.has_facility(F.col("aqu_type"), kind)).alias(kind)
            for kind in D.FACILITIES
        ]
    sums += [F.count_if(grown).alias("grown"), F.count_if(listed).alias("farmed")]
    return rows.groupBy(*keys).agg(*sums)


def _aquaculture_labelled(
    tables: SurveyTables,
    filters: Filters,
    cube: DataFrame | None,
    only: Column | None = None,
    more_keys: Sequence[str] = (),
) -> DataFrame:
    lists = _lists(filters, tables.codes)
    if cube is None:
        keys = list(dict.fromkeys([*_keys(lists), *more_keys]))
        cube = aquaculture_cube(tables.aquaculture_cells, filters, keys, only)
    return _labelled(cube, tables.codes, lists)


def _with_total(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total of the exact sums; total and columns are then rounded each by itself."""
    rounded = reshape.round_outputs(reshape.row_total(sums, columns), [*columns, D.TOTAL])
    named = {"province_kh": D.PROVINCE_HEADING} | {c: c for c in [*columns, D.TOTAL]}
    renamed = reshape.select_rename(rounded, named)
    return reshape.sort_desc_total(renamed, D.PROVINCE_HEADING)


def t07_aquaculture(
    tables: SurveyTables, filters: Filters = ALL, cube: DataFrame | None = None
) -> DataFrame:
    """Aquaculture harvest by province and species, this year and the one before together."""
    listed = (F.col("catch") > 0) & F.col("fish_code").isin(*D.SPECIES)
    rows = _aquaculture_labelled(tables, filters, cube, listed)
    rows = flt.apply_labels(rows, filters).where(F.col("farmed") > 0)
    species = list(D.SPECIES.values())
    return _with_total(reshape.multi_column_sum(rows, ["province_kh"], species), species)


def t07_aquaculture_detail(
    tables: SurveyTables, filters: Filters = ALL, cube: DataFrame | None = None
) -> DataFrame:
    """As `t07_aquaculture`, with fresh-water and sea fish, which the total counts once more.

    ``total_area`` is fresh-water and sea fish alone.
    """
    rows = _aquaculture_labelled(tables, filters, cube, F.col("catch") > 0, ["area_code"])
    water = coercion.to_double(F.col("area_code"))
    rows = rows.where(F.col("grown") > 0).withColumns({
        "province_kh": answers.trimmed(F.col("province_kh")),
        D.FRESH_FISH: F.when(water == int(D.AREA_FRESH), F.col("catch")),
        D.SEA_FISH: F.when(water == int(D.AREA_MARINE), F.col("catch")),
    })
    waters = [D.FRESH_FISH, D.SEA_FISH]
    columns = waters + list(D.SPECIES.values())
    rows = flt.apply_labels(rows, filters)
    sums = reshape.multi_column_sum(rows, ["province_kh"], columns)
    areas = reshape.round_outputs(reshape.row_total(sums, waters, "total_area"), ["total_area"])
    areas = reshape.row_total(areas, columns)
    rounded = reshape.round_outputs(areas, [*columns, D.TOTAL])
    out = [*columns, D.TOTAL, "total_area"]
    named = {"province_kh": D.PROVINCE_HEADING} | {c: c for c in out}
    return reshape.sort_desc_total(reshape.select_rename(rounded, named), D.PROVINCE_HEADING)


def t10_facilities(
    tables: SurveyTables, filters: Filters = ALL, cube: DataFrame | None = None
) -> DataFrame:
    """Ponds, batches and plastic soung by province; all 25 provinces unless one is chosen."""
    kinds = list(D.FACILITIES)
    given = tables.aquaculture_cells
    zeros = reshape.domain_frame(given.sparkSession, D.PROVINCES, "province_kh").select("province_kh")
    if "aqu_type" not in given.columns and not set(kinds) <= set(given.columns):
        rows = zeros.withColumns({k: F.lit(0) for k in kinds})
    else:
        rows = flt.apply_labels(_aquaculture_labelled(tables, filters, cube), filters)
        rows = rows.where(sum((F.col(f"`{k}`") for k in kinds), F.lit(0)) > 0)
        rows = rows.select("province_kh", *[f"`{k}`" for k in kinds])
        if filters.province is None:
            rows = rows.unionByName(zeros, allowMissingColumns=True)
    counts = reshape.multi_column_sum(rows, ["province_kh"], kinds)
    ordered = reshape.sort_by_domain(counts, "province_kh", D.PROVINCES)
    return ordered.select("province_kh", "`plastic soung`", "ponds", "batches")


def aqu_code_summary(tables: SurveyTables, wide: bool | str = True) -> DataFrame:
    """Harvest by province and species code, provinces numbered by descending total.

    The wide form has a column per species code, up to ``spark.sql.pivotMaxValues`` of them, and
    more are an error.  With ``wide="map"`` it has a map from code to catch; that and the long form
    have no such limit.
    """
    rows = flt.filter_positive(tables.aquaculture_cells, "catch")
    cells = rows.groupBy("province", "fish_code").agg(F.sum("catch").alias("total"))
    cells = tables.codes.label(cells, PROVINCE_LIST)
    cells = settle(reshape.group_sum(cells, ["province_kh", "fish_code"], "total", "total"))
    if wide == MAP:
        table = reshape.pivot_map(cells, ["province_kh"], "fish_code", "total", total="total_sum")
        table = reshape.row_number(table, "province_kh", "total_sum", "row_num")
        return table.select("row_num", "province_kh", "cells", "total_sum").orderBy("row_num")
    if not wide:
        sums = reshape.group_sum(cells, ["province_kh"], "total", "total_sum")
        ranked = reshape.row_number(sums, "province_kh", "total_sum", "row_num")
        ranked = ranked.withColumnRenamed("province_kh", "__province")
        same = F.col("province_kh").eqNullSafe(F.col("__province"))
        return cells.join(ranked, same).orderBy("row_num", F.col("fish_code").asc_nulls_last()).select(
            "row_num", "province_kh", "fish_code", "total", "total_sum"
        )
    cells = cells.withColumn("fish_code", F.coalesce("fish_code", F.lit("NA")))
    first_shown = [F.min("province_kh"), F.bool_and(F.col("fish_code") == "NA")]
    columns = reshape.column_values(cells, "fish_code", first_shown)
    table = reshape.pivot_cells(cells, ["province_kh"], "fish_code", "total", columns)
    table = reshape.row_total(table, columns, D.TOTAL)
    table = reshape.row_number(table, "province_kh", D.TOTAL, D.ROW_NUMBER_HEADING)
    named = {D.ROW_NUMBER_HEADING: D.ROW_NUMBER_HEADING, "province_kh": D.PROVINCE_OR_CAPITAL}
    named |= {c: c for c in [*columns, D.TOTAL]}
    return reshape.select_rename(table.orderBy(F.col(f"`{D.ROW_NUMBER_HEADING}`")), named)


# --- patrol ----------------------------------------------------------------------------------


def t08_enforcement(
    tables: SurveyTables, filters: Filters = ALL, domain: DataFrame | None = None
) -> DataFrame:
    """Enforcement outcomes by province, every province of the group shown, by English name.

    ``domain`` is `province_labels`, where the caller has it already.
    """
    given = tables.patrol_cells
    rows = flt.filter_year_pair(given, filters.year)
    rows = rows.where(flt.in_period(filters, years=_years(filters)))
    if is_cells(given):
        counted = [F.sum(F.col(f"`{label}`")).alias(label) for label in D.OUTCOMES.values()]
    else:
        rows = explode_codes(rows, "patrol_enforcement", "code", D.OUTCOMES)
        counted = [F.count_if(F.col("code") == c).alias(label) for c, label in D.OUTCOMES.items()]
    cube = rows.groupBy("province").agg(*counted)
    cases = _labelled(cube, tables.codes, [PROVINCE_LIST])
    cases = flt.apply_labels(cases, filters, area_rule=False)
    shown = province_labels(tables.offered, tables.codes) if domain is None else domain
    if filters.group is not None:
        offered = provinces_for_group(tables.codes, filters.group).select("province_kh")
        shown = shown.join(offered, "province_kh", "left_semi")
    zeros = shown.select("province_kh", F.col("province_en").alias("__order"))
    labels = list(D.OUTCOMES.values())
    both = cases.select("province_kh", *[f"`{c}`" for c in labels]).unionByName(
        zeros, allowMissingColumns=True
    )
    sums = [reshape.sum_or_zero(F.col(f"`{c}`")).alias(c) for c in labels]
    table = both.groupBy("province_kh").agg(*sums, F.min("__order").alias("__order"))
    ordered = table.orderBy(
        F.col("__order").asc_nulls_last(), F.col("province_kh").asc_nulls_last()
    )
    return ordered.select("province_kh", *[f"`{c}`" for c in labels])


REPORTS = {
    report.__name__: report
    for report in (
        t02_dai,
        t03_fishery_domain,
        t04_rice_field,
        t05_marine_province,
        t06_marine_species,
        t06_species_detail,
        t07_aquaculture,
        t07_aquaculture_detail,
        t08_enforcement,
        t10_facilities,
    )
}
