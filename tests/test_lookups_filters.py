import datetime
import itertools
import random

import pytest

from fieldtally.operators import filters as flt
from fieldtally.operators.filters import Filters, reconcile_filters, reconcile_selections
from fieldtally.operators.lookups import Codebook, code_list, label_fallback, lookup_left_join, measure
from fieldtally.sources.choices import read_choices

CHOICES = [
    ("provinces", "7", "k7", "e7"), ("provinces", None, "kn", "en"), ("provinces", "1", "k1", "e1"),
    ("type", "5", "f5", "F5"), ("type", "5", "f5b", "F5b"), ("area", "1", "a1", "Inland Fresh"),
    ("other", "1", "x", "X"), ("other", "1", "y", "Y"),
]
SCHEMA = "list_name string, name string, label_khmer string, label_english string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def choices(frame):
    return frame(CHOICES, SCHEMA)


def test_code_list(choices):
    fish = code_list(choices, "type")
    assert fish.columns == ["fish_code", "fish_name_kh", "fish_name_en"]
    assert fish.count() == 2


def test_join_matches_null_fans_out_and_keeps_raw_codes(frame, choices):
    df = frame([(1, "7", "5"), (2, "07", "9"), (3, None, None)], "i int, province string, fish_code string")
    joined = lookup_left_join(df, code_list(choices, "provinces"), "province", "province")
    assert rows(joined.select("i", "province_kh")) == [(1, "k7"), (2, None), (3, "kn")]
    labelled = Codebook(choices).label(df, "provinces", "type")
    assert rows(labelled.select("i", "province_kh", "fish_name_kh")) == [
        (1, "k7", "f5"), (1, "k7", "f5b"), (2, "07", "9"), (3, "kn", None)]


def test_fallback_only_fills_what_is_there(frame):
    df = frame([("7", None, None, "1")], "province string, province_kh string, area_kh string, area_code string")
    assert rows(label_fallback(df)) == [("7", "7", None, "1")]


def test_measure_finds_repeated_codes_and_sizes(choices):
    repeated, sizes = measure(choices)
    assert repeated == {"type"}
    assert set(sizes) == {"provinces", "type", "area"} and all(s > 0 for s in sizes.values())
    assert Codebook(choices).repeated == {"type"}


def test_measured_lists_are_broadcast_only_below_the_bound(choices):
    assert Codebook.measured(choices).small == {"provinces", "type", "area"}
    assert Codebook.measured(choices, max_bytes=10).small == frozenset()


def test_read_choices(spark, choices, tmp_path):
    choices.withColumn("more", choices.name).write.parquet(str(tmp_path / "c"))
    assert rows(read_choices(spark, str(tmp_path / "c"))) == rows(choices)
    choices.write.option("header", True).csv(str(tmp_path / "v"))
    read = read_choices(spark, str(tmp_path / "v"), "csv", {"header": "true"})
    assert read.count() == len(CHOICES)


def test_filters_take_form_values():
    chosen = Filters(group="All", year="2024", quarter="Q2", month="4", week="Week3", province="All")
    assert (chosen.group, chosen.province) == (None, None)
    assert (chosen.year, chosen.quarter, chosen.month, chosen.week) == (2024, 2, 4, 3)


@pytest.mark.parametrize("bad", [
    {"group": "Sea"}, {"quarter": "Q5"}, {"month": 13}, {"week": "WeekNA"}, {"year": "x"}])
def test_bad_filters_are_refused(bad):
    with pytest.raises(ValueError):
        Filters(**bad)


def test_year_filters(frame):
    days = [datetime.date(y, m, d) for y, m, d in
            ((2022, 12, 31), (2023, 1, 1), (2023, 12, 31), (2024, 1, 1), (2024, 12, 31), (2025, 1, 1))]
    df = frame([(d,) for d in days] + [(None,)], "date date")
    assert rows(flt.filter_year_exact(df, 2023)) == [(d,) for d in days[1:3]]
    assert rows(flt.filter_year_pair(df, 2024)) == [(d,) for d in days[1:5]]
    assert flt.filter_year_pair(df, None) is df


def test_inland_takes_inland_areas_only(frame):
    df = frame(
        [(1, "Inland", "1", None), (2, "Inland", "01", None), (3, "Inland", "2", "Marine"),
         (4, "Inland", "9", "FRESH water"), (5, "Marine", "1", None), (6, "Inland", None, None)],
        "i int, province_group string, area_code string, area_en string")
    assert [r[0] for r in rows(flt.filter_group(df, "Inland").select("i"))] == [1, 2, 4]
    assert [r[0] for r in rows(flt.filter_group(df, "Marine").select("i"))] == [5]
    assert flt.filter_group(df, None).count() == 6


def test_positive_filters(frame):
    day = datetime.date(2024, 1, 1)
    values = [0.4, 0.5, 0.6, -1.0, None, float("nan"), 3e9, 1.5]
    df = frame([(i, v, day) for i, v in enumerate(values)] + [(9, 5.0, None)], "i int, v double, date date")
    assert [r[0] for r in rows(flt.filter_positive(df, "v"))] == [0, 1, 2, 6, 7, 9]
    assert [r[0] for r in rows(flt.filter_positive_rounded(df, "v"))] == [2, 7]


def test_not_equal_drops_null(frame):
    df = frame([("a",), ("b",), (None,)], "x string")
    assert rows(flt.filter_not_equal(df, "x", "a")) == [("b",)]


def test_reconcile():
    old = Filters(group="Marine", province="p", area="Marine", quarter=1, month=2)
    group = reconcile_filters(old, old.with_(group="Inland"), ("Inland Fresh",))
    assert (group.province, group.area, group.month) == (None, None, 2)
    kept = reconcile_filters(old, old.with_(group=None), ("Marine", "Inland Fresh"))
    assert (kept.province, kept.area) == (None, "Marine")
    assert reconcile_filters(old, old.with_(quarter=2)).month is None
    assert reconcile_filters(old, old.with_(quarter=None)).month == 2
    assert reconcile_filters(old, old.with_(month=12)).quarter == 4
    assert reconcile_filters(old, old.with_(month=None)).quarter == 1
    assert reconcile_filters(old, old) == old


def test_months_of_quarter():
    assert [flt.months_of_quarter(q) for q in (1, 2, 3, 4)] == [
        (1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12)]


@pytest.mark.parametrize("year", [1, 2, 9998, 9999])
def test_every_year_can_be_asked_for(frame, year):
    days = [datetime.date(y, m, 1) for y in (1, 2, 9997, 9998, 9999) for m in (1, 12)]
    df = frame([(d,) for d in days], "date date")
    for chosen in (flt.Filters(year=year), flt.Filters(year=year, month=12), flt.Filters(year=year, quarter=1)):
        years = (year - 1, year)
        got = flt.filter_year_pair(df, year).where(flt.in_period(chosen, years=years)).collect()
        months = {12} if chosen.month else {1} if chosen.quarter else {1, 12}
        assert {r.date for r in got} == {d for d in days if d.year in years and d.month in months}
    both = flt.Filters(year=2, quarter=1, month=12)
    assert df.where(flt.in_period(both, years=(1, 2))).count() == 0


def test_reconcile_row_by_row(spark):
    """Every change of one or more filters, as the function of one selection gives it."""
    names = ("group", "province", "area", "quarter", "month")
    values = list(itertools.product((None, "Inland", "Marine"), (None, "p"), (None, "a", "b"), (None, 1, 4), (None, 2, 12)))
    draw = random.Random(6)
    rows = [(i, draw.choice(values), draw.choice(values), draw.choice([None, [], ["a"], ["a", "b"]])) for i in range(400)]
    rows += [(400 + i, v, (*v[:4], m), None) for i, (v, m) in enumerate(itertools.product(draw.sample(values, 20), (None, 2, 5, 12)))]
    kind = "struct<group: string, province: string, area: string, quarter: int, month: int>"
    found = reconcile_selections(spark.createDataFrame(rows, f"i int, old {kind}, new {kind}, areas array<string>"))
    kept = {r.i: tuple(r.kept) for r in found.collect()}
    for i, old, new, areas in rows:
        one = reconcile_filters(*(Filters(**dict(zip(names, v))) for v in (old, new)), None if areas is None else tuple(areas))
        assert kept[i] == tuple(getattr(one, n) for n in names), (old, new, areas)
