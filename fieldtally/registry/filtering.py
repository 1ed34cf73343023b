"""Each filter and predicate by itself, on the enriched capture rows."""

from __future__ import annotations

from fieldtally import domains as D
from fieldtally.operators import filters as flt
from fieldtally.plans import enrich, typed
from fieldtally.registry.core import query
from fieldtally.registry.reporting import INLAND, WHOLE
from fieldtally.registry.sql import texts, with_tables
from fieldtally.sources import star


def _capture(spark, sf):
    """Typed capture with the labels of provinces and areas."""
    codes = star.codebook(spark, sf)
    return codes.label(typed.typed_capture(star.capture(spark, sf)), "provinces", "area")


def kept_sql(where: str, columns: str = "id, pos, catch") -> str:
    return with_tables(f"SELECT {columns} FROM capture WHERE {where}", "capture")


def _keep(df):
    return df.select("id", "pos", "catch")


@query("filter_group", kept_sql(INLAND))
def _(spark, sf):
    return _keep(flt.filter_group(_capture(spark, sf), "Inland"))


@query("filter_group__marine", kept_sql("province_group = 'Marine'"))
def _(spark, sf):
    return _keep(flt.filter_group(_capture(spark, sf), "Marine"))


@query("filter_group_only", with_tables(
    "SELECT id, patrol_enforcement FROM patrol WHERE province_group = 'Inland'", "patrol"
))
def _(spark, sf):
    rows = enrich.enrich_patrol(star.patrol(spark, sf), star.codebook(spark, sf))
    return flt.filter_group_only(rows, "Inland").select("id", "patrol_enforcement")


@query("filter_province", kept_sql(f"province_kh = '{D.PROVINCES[7]}'"))
def _(spark, sf):
    return _keep(flt.filter_province(_capture(spark, sf), D.PROVINCES[7]))


@query("filter_area", kept_sql("area_en = 'Marine'"))
def _(spark, sf):
    return _keep(flt.filter_area(_capture(spark, sf), "Marine"))


@query("filter_year_exact", kept_sql("year = 1999"))
def _(spark, sf):
    return _keep(flt.filter_year_exact(_capture(spark, sf), 1999))


@query("filter_year_pair", kept_sql("year IN (1998, 1999)"))
def _(spark, sf):
    return _keep(flt.filter_year_pair(_capture(spark, sf), 1999))


@query("filter_quarter", kept_sql("quarter = 'Q4'"))
def _(spark, sf):
    return _keep(flt.filter_quarter(_capture(spark, sf), 4))


@query("filter_month", kept_sql("month = 6"))
def _(spark, sf):
    return _keep(flt.filter_month(_capture(spark, sf), 6))


@query("filter_week", kept_sql("week = 'Week5'"))
def _(spark, sf):
    return _keep(flt.filter_week(_capture(spark, sf), 5))


@query("apply_filters", kept_sql(
    f"{INLAND} AND year IN (1997, 1998) AND quarter = 'Q2' AND month = 5 AND week = 'Week1'"
    " AND area_en = 'Inland Fresh'"
))
def _(spark, sf):
    chosen = flt.Filters(
        group="Inland", area="Inland Fresh", year=1998, quarter="Q2", month=5, week="Week1"
    )
    rows = flt.filter_year_pair(_capture(spark, sf), chosen.year).where(flt.in_period(chosen))
    return _keep(flt.apply_labels(rows, chosen))


@query("filter_positive_rounded", kept_sql(f"{WHOLE} > 0"))
def _(spark, sf):
    return _keep(flt.filter_positive_rounded(_capture(spark, sf), "catch"))


@query("filter_positive", kept_sql("catch > 0"))
def _(spark, sf):
    return _keep(flt.filter_positive(_capture(spark, sf), "catch"))


@query("filter_not_equal", kept_sql(f"province_kh <> '{D.EXCLUDED_FROM_MARINE}'"))
def _(spark, sf):
    return _keep(flt.filter_not_equal(_capture(spark, sf), "province_kh", D.EXCLUDED_FROM_MARINE))


@query("filter_in_list", kept_sql(f"province_kh IN ({texts(D.DAI_PROVINCES)})"))
def _(spark, sf):
    return _keep(flt.filter_in_list(_capture(spark, sf), "province_kh", D.DAI_PROVINCES))


@query("filter_codes", kept_sql("area_code = '1' AND fishing_type = '3'"))
def _(spark, sf):
    return _keep(flt.filter_codes(_capture(spark, sf), area_code="1", fishing_type="3"))


@query("filter_key_present", with_tables(
    "SELECT id, pos FROM aqu WHERE aqu_type IS NOT NULL AND year IS NOT NULL", "aqu"
))
def _(spark, sf):
    rows = typed.typed_aquaculture(star.aquaculture(spark, sf))
    return flt.filter_key_present(rows, "aqu_type", "year").select("id", "pos")
