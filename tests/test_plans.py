"""What the planner makes of the reports."""

import re

import pytest
from pyspark.sql import functions as F

from fieldtally.operators.filters import Filters
from fieldtally.operators.lookups import label_fallback, lookup_left_join
from fieldtally.plans import reports as R
from fieldtally.plans.typed import typed_capture
from fieldtally.sources import dealt, star

SF = "/root/testdata/sf0.001"
F98 = Filters(year=1998, quarter="Q1")


def plan(df, mode="simple"):
    """The final plan, after adaptive planning, as the query was run."""
    df.collect()
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    text = df._jdf.queryExecution().explainString(modes.fromString(mode))
    return text.split("== Initial Plan ==")[0] if mode == "simple" else text


@pytest.fixture(scope="module")
def tables(spark):
    return star.tables(spark, SF)


FIXED = [R.t02_dai, R.t03_fishery_domain, R.t04_rice_field, R.t05_marine_province,
         R.t07_aquaculture, R.t07_aquaculture_detail, R.t10_facilities]


@pytest.mark.parametrize("report", FIXED, ids=lambda r: r.__name__)
def test_rows_are_read_once_and_summed_before_any_join(tables, report):
    text = plan(report(tables, F98))
    facts = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert len(facts) == 1
    # codes, labels, order: the first of them moves partial sums, the others a row per province
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    below_first_sum = text[text.rindex("partial_"):] if report is not R.t10_facilities else ""
    scan_side = below_first_sum.split("BroadcastExchange")[0]
    assert "Join" not in scan_side


@pytest.mark.parametrize("report", FIXED, ids=lambda r: r.__name__)
def test_year_range_and_columns_reach_the_scan(tables, report):
    text = plan(report(tables, F98), "formatted")
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in pushed
    assert "LessThan(l_shipdate,1999-01-01" in pushed
    schema = next(line for line in text.splitlines() if "ReadSchema" in line and "l_shipdate" in line)
    assert "l_extendedprice" not in schema and "l_tax" not in schema


@pytest.mark.parametrize("report", FIXED, ids=lambda r: r.__name__)
@pytest.mark.parametrize(("chosen", "ends"), [
    ({"quarter": 1}, [("1997-01-01", "1997-04-01"), ("1998-01-01", "1998-04-01")]),
    ({"month": 12}, [("1997-12-01", "1998-01-01"), ("1998-12-01", "1999-01-01")]),
])
def test_quarter_and_month_reach_the_scan_as_ranges(tables, report, chosen, ends):
    text = plan(report(tables, Filters(year=1998, **chosen)), "formatted")
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line)
    for first, behind in ends:
        assert re.search(rf"And\(GreaterThanOrEqual\(l_shipdate,{first}.{{0,9}}\),LessThan\(l_shipdate,{behind}", pushed)


def test_species_cells_are_computed_once(tables):
    text = plan(R.t06_marine_species(tables, Filters(year=1998), wide=False))
    assert "ReusedExchange" in text
    assert len([x for x in text.splitlines() if "FileScan" in x and "l_shipdate" in x]) == 1
    assert "TakeOrderedAndProject" in text


def test_no_python_in_any_plan(spark, tables):
    for df in (R.t08_enforcement(tables), R.t10_facilities(tables), R.aqu_code_summary(tables, wide=False)):
        text = plan(df)
        assert "Python" not in text and "Pandas" not in text


def test_small_code_list_is_broadcast_and_a_large_one_is_not(spark, tables):
    rows = typed_capture(star.capture(spark, SF))
    fish = tables.codes.list("type")
    assert "BroadcastHashJoin" in plan(lookup_left_join(rows, fish, "fish_code", "fish_code"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set(adaptive, "-1")
        joined = lookup_left_join(rows, fish, "fish_code", "fish_code")
        assert "SortMergeJoin" in plan(joined)
        # the reports then join sums, not rows, and give the same
        report = R.t06_species_detail(tables, Filters(year=1998), wide=False)
        unhinted = [tuple(r) for r in report.collect()]
        assert "SortMergeJoin" in plan(report)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset(adaptive)
    again = R.t06_species_detail(tables, Filters(year=1998), wide=False)
    assert [tuple(r) for r in again.collect()] == unhinted


def test_a_hot_code_is_split_where_the_list_is_too_large_to_broadcast(spark, tmp_path):
    """A third of all rows have one code."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "8",
    }
    rows = spark.range(0, 200000, 1, 16).selectExpr(
        "id", "IF(id % 3 = 0, '7', CAST(id % 5000 AS STRING)) AS fish_code", "uuid() AS more")
    rows.write.parquet(str(tmp_path / "rows"))
    codes = spark.range(5000).selectExpr("CAST(id AS STRING) AS code", "CONCAT('n', id) AS label")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = lookup_left_join(spark.read.parquet(str(tmp_path / "rows")), codes, "fish_code", "code")
        assert "SortMergeJoin(skew=true)" in plan(joined)
        assert joined.where("label = CONCAT('n', fish_code)").count() == 200000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_dealt_tables_join_without_a_shuffle(spark, tmp_path):
    """Missing, unlisted and repeated codes, and one code of most rows, as by the usual join."""
    codes = [None, "1", "2", "x", *["7"] * 40]
    rows = spark.createDataFrame([(i, i % 3, c) for i, c in enumerate(codes)], "id long, pos int, fish_code string")
    listed = [("1", "a", "A"), ("2", "b", "B"), ("2", "b2", "B2"), (None, "n", "N"), ("7", "s", None)]
    lookup = spark.createDataFrame(listed, "fish_code string, fish_name_kh string, fish_name_en string")
    kept = dealt.deal_rows(rows, "fish_code", "dealt_rows", str(tmp_path / "rows"), buckets=8)
    names = dealt.deal_list(lookup, "fish_code", "dealt_list", str(tmp_path / "list"), buckets=8)
    found = dealt.label_dealt(kept, names)
    expected = label_fallback(lookup_left_join(rows, lookup, "fish_code", "fish_code"))
    assert found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert "Exchange" not in plan(found)
    hot = kept.where("fish_code = '7'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot > 2
    spark.sql("DROP TABLE dealt_rows")
    spark.sql("DROP TABLE dealt_list")
