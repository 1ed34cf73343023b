"""All sheets of one export from one pass over each table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldtally.operators.filters import ALL, Filters
from fieldtally.operators.lookups import AREA_LIST, FISH_LIST, LABELS, PROVINCE_LIST
from fieldtally.plans import reports as R
from fieldtally.plans.options import province_labels
from fieldtally.plans.typed import SurveyTables
from fieldtally.session import settle_all


def report_bundle(tables: SurveyTables, filters: Filters = ALL) -> dict[str, DataFrame]:
    """The nine result tables of the export, by report name.

    Capture and aquaculture are each summed once, by all codes any sheet needs, and the sums are
    settled; the sheets are made from those.
    """
    province, fish, area = (LABELS[n][0] for n in (PROVINCE_LIST, FISH_LIST, AREA_LIST))
    by_codes = [province, area] + ([fish] if FISH_LIST in tables.codes.repeated else [])
    wild, farmed, shown = settle_all(
        R.capture_cube(tables.capture, filters, [province, fish, area, "fishing_type"]),
        R.aquaculture_cube(tables.aquaculture, filters, by_codes),
        province_labels(tables.offered, tables.codes),
    )
    return {
        "t06_species_detail": R.t06_species_detail(tables, filters, wild),
        "t06_marine_species": R.t06_marine_species(tables, filters, wild),
        "t07_aquaculture": R.t07_aquaculture(tables, filters, farmed),
        "t05_marine_province": R.t05_marine_province(tables, filters, wild),
        "t04_rice_field": R.t04_rice_field(tables, filters, wild),
        "t03_fishery_domain": R.t03_fishery_domain(tables, filters, wild),
        "t02_dai": R.t02_dai(tables, filters, wild),
        "t08_enforcement": R.t08_enforcement(tables, filters, shown),
        "t10_facilities": R.t10_facilities(tables, filters, farmed),
    }
