import pytest
from pyspark.sql import functions as F

from fieldtally.operators import cleaning
from fieldtally.operators.repeats import explode_codes, explode_facilities, explode_repeat, require_results
from fieldtally.plans import clean


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clean_name():
    names = ["_id", "nat_fishcatch/Nat Catch", "__a--b__", "meta/instanceID", "A.b"]
    assert [cleaning.clean_name(n) for n in names] == [
        "id", "nat_fishcatch_nat_catch", "a_b", "meta_instanceid", "a_b"]


def test_names_that_collide_are_refused(frame):
    with pytest.raises(ValueError, match="a_b"):
        cleaning.normalize_names(frame([(1, 2)], "`a/b` int, `A b` int"))


def test_flatten_any_depth(frame):
    df = frame([((1, (2, "x")), [3])], "a struct<b:int, c:struct<`d.e`:int, f:string>>, g array<int>")
    flat = cleaning.flatten_struct(df)
    assert flat.columns == ["a_b", "a_c_d.e", "a_c_f", "g"]
    assert rows(flat) == [(1, 2, "x", [3])]


def test_select_drop_ensure_resolve(frame):
    df = frame([(1, 2)], "a int, b int")
    assert cleaning.select_present(df, ["b", "z"]).columns == ["b"]
    assert cleaning.drop_columns(df, ["a", "z"]).columns == ["b"]
    assert rows(cleaning.ensure_columns(df, ["a", "c"])) == [(1, 2, 0)]
    assert cleaning.resolve_column(df, ["z", "b", "a"]) == "b"
    assert cleaning.resolve_column(df, ["z"]) is None


def test_fills_leave_keys_alone(frame):
    df = frame([(None, None, None), (1, "", 2.0)], "id int, s string, v double")
    assert rows(cleaning.fill_zero(df, ["v"])) == [(None, None, 0.0), (1, "", 2.0)]
    assert rows(cleaning.fill_unspecified(df)) == [(None, "unspecified", None), (1, "", 2.0)]
    assert rows(cleaning.fill_missing_text(df)) == [(None, "null", None), (1, "null", 2.0)]
    assert rows(cleaning.blank_to_null_token(df)) == [(None, None, None), (1, "null", 2.0)]


def test_explode_repeat_drops_empty_parents_and_keeps_null_fields(frame):
    df = frame(
        [(1, [("a",), (None,)]), (2, []), (3, None), (4, [None])],
        "_id int, rep array<struct<`rep/x`:string>>",
    )
    out = explode_repeat(df, "rep", ["_id", "absent"])
    assert out.columns == ["_id", "pos", "rep/x"]
    assert sorted(rows(out), key=str) == [(1, 0, "a"), (1, 1, None), (4, 0, None)]


def test_missing_repeat_group_is_an_empty_table(frame):
    df = frame([(1, "7", "2025-01-01")], "_id bigint, province string, date string")
    with pytest.warns(UserWarning, match="nat_fishcatch"):
        out = clean.clean_capture(df)
    assert out.count() == 0
    assert "nat_fishcatch_nat_catch" in out.columns and "pos" in out.columns


def test_missing_results_is_an_error(frame):
    with pytest.raises(ValueError, match="results"):
        require_results(frame([(1,)], "x int"))


def test_explode_codes_keeps_repeats(frame):
    df = frame([(1, "2 3 6"), (2, "2,2"), (3, "x2"), (4, "26"), (5, ""), (6, None)], "i int, c string")
    kept = rows(explode_codes(df, "c", "code", ["2", "3", "6"]).select("i", "code"))
    assert sorted(kept) == [(1, "2"), (1, "3"), (1, "6"), (2, "2"), (2, "2"), (3, "2")]
    assert explode_codes(df, "c", "code").count() == 7


def test_explode_facilities_counts_each_once(frame):
    df = frame([(1, "pond ponds batch"), (2, "other"), (3, None)], "i int, t string")
    out = rows(explode_facilities(df, "t", "type").select("i", "type"))
    assert sorted(out) == [(1, "batches"), (1, "ponds")]


def test_stringify(frame):
    df = frame([(1, None)], "a int, b string").withColumns({
        "d": F.lit("2025-03-01").cast("date"),
        "t": F.lit("2025-03-01 10:00:00.5").cast("timestamp"),
        "n": F.lit("2025-03-01 10:00:00.5").cast("timestamp_ntz"),
    })
    out = cleaning.stringify_all(df)
    assert {t for _, t in out.dtypes} == {"string"}
    assert rows(out) == [("1", None, "2025-03-01", "2025-03-01 10:00:00", "2025-03-01 10:00:00")]


def test_multiselect_of_either_type(frame):
    listed = frame([(["2", "3"],), ([],), (None,)], "c array<string>")
    assert rows(cleaning.multiselect_to_text(listed, "c")) == [("2,3",), ("null",), ("null",)]
    text = frame([("2 3",), (None,)], "c string")
    assert rows(cleaning.multiselect_to_text(text, "c")) == [("2 3",), ("null",)]
    assert cleaning.multiselect_to_text(text, "absent") is text
