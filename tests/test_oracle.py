"""Every registered query against its SQL in DuckDB."""

import pathlib

import pytest

import __spark_entry__ as entry
from check import TESTDATA, compare, database
from fieldtally.registry import core

FOLDER = TESTDATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    if not pathlib.Path(FOLDER).exists():
        pytest.skip("no test tables")
    return database(FOLDER)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, str(FOLDER), name)
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["province_kh", "1997", "1998"]
    assert df.count() == 25
