import pytest

from fieldtally.operators import reshape


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def sales(frame):
    return frame(
        [("a", 1, 2.0), ("a", 2, None), ("b", 1, None), ("c", 3, 4.0), ("c", 3, 1.0), (None, 1, 7.0)],
        "k string, y int, v double")


def test_sums_ignore_missing(sales):
    out = sorted(rows(reshape.group_sum(sales, ["k"], "v", "s")), key=str)
    assert out == [("a", 2.0), ("b", 0.0), ("c", 5.0), (None, 7.0)]


def test_pivot_fixed_and_from_data(sales):
    fixed = reshape.pivot_wide(sales, ["k"], "y", "v", [1, 9])
    assert fixed.columns == ["k", "1", "9"]
    found = reshape.pivot_wide(sales, ["k"], "y", "v")
    assert found.columns == ["k", "1", "2", "3"]
    assert ("c", 0.0, 0.0, 5.0) in rows(found)


def test_too_many_columns_are_refused(spark, sales):
    most = spark.conf.get("spark.sql.pivotMaxValues")
    try:
        spark.conf.set("spark.sql.pivotMaxValues", "2")
        with pytest.raises(ValueError, match="more than 2"):
            reshape.pivot_wide(sales, ["k"], "y", "v")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", most)


def test_target_years(sales):
    assert reshape.target_years(sales, 2024, "y") == [2023, 2024]
    assert reshape.target_years(sales, None, "y") == [1, 2, 3]


def test_missing_keys_and_zero_rows(spark, sales):
    domain = reshape.domain_frame(spark, ("z", "a", "q"), "k")
    assert rows(domain) == [("z", 0), ("a", 1), ("q", 2)]
    sums = reshape.group_sum(sales.where("k = 'a'"), ["k"], "v", "s")
    assert sorted(rows(reshape.missing_keys(domain.select("k"), sums, "k"))) == [("q",), ("z",)]
    assert sorted(rows(reshape.append_zero_rows(sums, domain, "k"))) == [
        ("a", 2.0), ("q", 0.0), ("z", 0.0)]


def test_grid(sales):
    cells = reshape.group_sum(sales, ["k", "y"], "v", "v")
    assert sorted(rows(reshape.zero_fill_grid(cells, "k", "y", "v", ("a", "z"), [1, 5]))) == [
        ("a", 1, 2.0), ("a", 5, 0.0), ("z", 1, 0.0), ("z", 5, 0.0)]
    assert len(rows(reshape.zero_fill_grid(cells, "k", "y", "v", ("a", "z")))) == 6


def test_merge_is_null_safe(frame):
    left = frame([("a", 1, 5), (None, 1, 6)], "k string, y int, l int")
    right = frame([(None, 1, 2)], "k string, y int, r int")
    merged = reshape.merge_summaries(left, right, ["k", "y"])
    assert merged.columns == ["k", "y", "l", "r"]
    assert sorted(rows(merged), key=str) == [("a", 1, 5, 0), (None, 1, 6, 2)]


def test_total_rounding_and_order(frame):
    df = frame([("b", 0.5, 2.5), ("a", 1.5, 1.5), ("c", None, 9.0)], "k string, `x y` double, z double")
    total = reshape.row_total(df, ["x y", "z"], "t")
    assert [r[3] for r in rows(total)] == [3.0, 3.0, 9.0]
    rounded = reshape.round_outputs(total, ["x y", "z", "t"])
    ordered = reshape.sort_desc_total(rounded, "k", "t")
    assert rows(ordered) == [("c", None, 9, 9), ("a", 2, 2, 3), ("b", 0, 2, 3)]
    assert rows(reshape.top_k(rounded, "k", "t", 2)) == rows(ordered)[:2]
    assert sorted((r.n, r.k) for r in reshape.row_number(rounded, "k", "t", "n").collect()) == [
        (1, "c"), (2, "a"), (3, "b")]


def test_domain_order_puts_unknown_last(frame):
    df = frame([("x",), ("a",), ("b",), (None,), ("w",)], "k string")
    assert [r[0] for r in rows(reshape.sort_by_domain(df, "k", ("b", "a")))] == ["b", "a", "w", "x", None]


def test_rename(frame):
    df = frame([(1, 2)], "a int, `b.c` int")
    assert reshape.select_rename(df, {"b.c": "x.y", "a": "z"}).columns == ["x.y", "z"]


def test_row_number_over_many_parts(spark):
    # totals of which a third are the same
    df = spark.range(3000).selectExpr("id AS k", "IF(id % 3 = 0, 5, id) AS t")
    limit = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        numbered = reshape.row_number(df, "k", "t", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", limit)
    ranked = sorted(numbered, key=lambda r: (-r.t, r.k))
    assert [r.n for r in ranked] == list(range(1, 3001))
