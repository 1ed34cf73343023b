import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8", "2")


@pytest.fixture
def frame(spark):
    """A small frame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def one(spark):
    """A text column function applied to each of some texts."""

    def apply(function, texts, dtype="string"):
        from pyspark.sql import functions as F

        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, f"i int, x {dtype}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]

    return apply
