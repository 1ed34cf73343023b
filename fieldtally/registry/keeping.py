"""Reports from kept partial sums, against the SQL of the reports from rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldtally.operators.filters import Filters
from fieldtally.plans import reports as R
from fieldtally.registry import reporting  # noqa: F401  (registers the SQL)
from fieldtally.registry.core import SQL, query
from fieldtally.session import shared_folder
from fieldtally.sources import star
from fieldtally.sources.staging import NAMES
from fieldtally.sources.warehouse import Warehouse


def published(spark: SparkSession, sf: str) -> Warehouse:
    """The survey tables in a folder of their own, published whole and then one year once more."""
    tables = star.tables(spark, sf)
    kept = Warehouse(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", tables.codes)
    kept = kept.publish({name: getattr(tables, name) for name in NAMES})
    return kept.publish({name: getattr(kept, name).where("year = 1998") for name in NAMES}, [1998])


CHOICES = {
    "t05_marine_province__y1998_q1": lambda t: R.t05_marine_province(t, Filters(year=1998, quarter="Q1")),
    "t06_species_detail__inland_y1998": lambda t: R.t06_species_detail(t, Filters(group="Inland", year=1998), wide=False),
    "t07_aquaculture_detail__y1998": lambda t: R.t07_aquaculture_detail(t, Filters(year=1998)),
    "t08_enforcement": lambda t: R.t08_enforcement(t),
    "t10_facilities__y1998": lambda t: R.t10_facilities(t, Filters(year=1998)),
    "aqu_code_summary": lambda t: R.aqu_code_summary(t, wide=False),
}


def _register(name: str, report) -> None:
    @query(f"kept_sums__{name.split('__')[0]}", SQL[name])
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return report(published(spark, sf))


for _name, _report in CHOICES.items():
    _register(_name, _report)
