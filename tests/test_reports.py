"""Reports on random rows with every awkward value, against plain Python."""

import datetime
import random

import pytest

import brute
from fieldtally import domains as D
from fieldtally.operators.filters import Filters
from fieldtally.operators.lookups import Codebook
from fieldtally.plans import reports as R
from fieldtally.plans.bundle import report_bundle
from fieldtally.plans.typed import SurveyTables

PROVINCE_CODES = ["7", "07", "9", "1", "2", "6", "8", "12", "14", "99", None]
# one province code and one species code have two labels, one area code has no local label
CHOICES = (
    [("provinces", str(i + 1), p, f"Province {i + 1:02}") for i, p in enumerate(D.PROVINCES[:20])]
    + [("provinces", "2", "second", "Another"), ("type", "5", "eel", "Eel"), ("type", "5", "snake", "Snake")]
    + [("type", str(i), f"fish{i % 7}", f"Fish{i}") for i in range(10, 90)]
    + [("area", "1", "ទឹកសាប", "Inland Fresh"), ("area", "2", None, "Marine Capture")]
)
FISH = ["5", "22", "77", "78", "85", "FM046", "nolabel", "40", "41", "42"]
VALUES = [0.5, 1.5, 2.5, -1.0, 0.0, 12.0, 3.5, 100.25, None, float("nan"), 0.375]
TYPES = ["pond", "Ponds_batch", "plastic-soung", "other", "", None, "soung BATCHES pond"]
CODES = ["2 3 6", "2,2", "x2", "12", "", "null", None, "6"]

random_ = random.Random(7)


def day():
    if random_.random() < 0.05:
        return None
    return datetime.date(2022 + random_.randrange(4), random_.randrange(1, 13), random_.randrange(1, 29))


def make(n, **columns):
    return [
        {"id": 1000 + random_.randrange(n), "pos": i, "date": day(),
         "province": random_.choice(PROVINCE_CODES)}
        | {name: random_.choice(values) for name, values in columns.items()}
        for i, _ in enumerate(range(n))
    ]


AREAS = ["1", "01", "2", "3", None]
CAPTURE = make(700, catch=VALUES, area_code=["1", "1", "2", "01", None], fishing_type=["1", "2", "3"], fish_code=FISH)
AQU = make(500, catch=VALUES, area_code=AREAS, fish_code=FISH, aqu_type=TYPES)
PROCESSING = make(60, amount=VALUES, kind=["1"], area_code=AREAS)
PATROL = make(300, amount=VALUES, patrol_enforcement=CODES)

CHOSEN = [
    Filters(),
    Filters(year=2024),
    Filters(year=2024, quarter="Q1"),
    Filters(year=2023, month=5),
    Filters(week="Week4", group="Marine"),
    Filters(group="Inland", year=2025),
    Filters(province=D.PROVINCES[6], year=2023),
    Filters(area="Marine Capture"),
    Filters(group="Inland", area="Inland Fresh", quarter="Q2"),
    Filters(year=1990),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")

    def stored(rows, ddl, name):
        spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def frame(rows, names, schema):
        keys = ["id", "pos", "date", "province", *names]
        ddl = "id bigint, pos int, date date, province string, " + schema
        return stored([tuple(r[k] for k in keys) for r in rows], ddl, f"{names[-1]}-{len(rows)}")

    choices = stored(
        CHOICES, "list_name string, name string, label_khmer string, label_english string", "choices")
    tables = SurveyTables.of_cleaned(
        Codebook(choices),
        capture=frame(
            CAPTURE, ["catch", "area_code", "fishing_type", "fish_code"],
            "nat_fishcatch_nat_catch double, nat_fishcatch_area_nat string,"
            " nat_fishcatch_type_fishing string, nat_fishcatch_nat_fishtype string"),
        aquaculture=frame(
            AQU, ["catch", "area_code", "aqu_type", "fish_code"],
            "aqu_fishcatch_aqu_catch double, aqu_fishcatch_area_aqu string,"
            " aqu_fishcatch_aqu_type string, aqu_fishcatch_aqu_fishtype string"),
        processing=frame(
            PROCESSING, ["amount", "kind", "area_code"],
            "processing_amountprocessing double, processing_typeprocessing string,"
            " processing_area_pro string"),
        patrol=frame(PATROL, ["amount", "patrol_enforcement"], "patrol_amount double, patrol_enforcement string"),
    )
    assert tables.codes.repeated == {"provinces", "type"}
    return tables


def nan_is_missing(rows):
    return [r | {"catch": None if r["catch"] != r["catch"] else r["catch"]} for r in rows]


@pytest.fixture(scope="module")
def expected():
    return {
        "capture": brute.enrich(nan_is_missing(CAPTURE), CHOICES),
        "aqu": brute.enrich(nan_is_missing(AQU), CHOICES),
        "processing": brute.enrich(PROCESSING, CHOICES, fish=False),
        "patrol": brute.enrich(PATROL, CHOICES, fish=False, area=False),
    }


def got(df):
    return df.columns, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("f", CHOSEN, ids=str)
def test_capture_reports(tables, expected, f):
    for report, spec in (
        (R.t05_marine_province, ("2", None, None, False, D.EXCLUDED_FROM_MARINE)),
        (R.t04_rice_field, ("1", "3", D.PROVINCES, False, None)),
        (R.t03_fishery_domain, ("1", "2", D.PROVINCES, True, None)),
        (R.t02_dai, ("1", "1", D.DAI_PROVINCES, True, None)),
    ):
        columns, rows = brute.province_years(expected["capture"], f, *spec)
        assert got(report(tables, f)) == (columns, rows), report.__name__
        if f.week or f.quarter == 1 or f.year == 1990:
            long = [(r[0], int(y), v) for r in rows for y, v in zip(columns[1:], r[1:])]
            assert got(report(tables, f, wide=False))[1] == long, report.__name__


@pytest.mark.parametrize("f", CHOSEN, ids=str)
def test_species_reports(tables, expected, f):
    for report, marine in ((R.t06_marine_species, True), (R.t06_species_detail, False)):
        columns, rows = brute.species(expected["capture"], f, marine)
        assert got(report(tables, f)) == (columns, rows)
        long = [
            (r[0], None if p == "NA" else p, c, r[-1]) for r in rows
            for p, c in sorted(zip(columns[1:-1], r[1:-1]), key=lambda x: (x[0] == "NA", x[0])) if c
        ]
        assert got(report(tables, f, wide=False))[1] == long


@pytest.mark.parametrize("f", CHOSEN, ids=str)
def test_aquaculture_reports(tables, expected, f):
    assert got(R.t07_aquaculture(tables, f))[1] == brute.aquaculture(expected["aqu"], f, False)
    assert got(R.t07_aquaculture_detail(tables, f))[1] == brute.aquaculture(expected["aqu"], f, True)
    assert got(R.t10_facilities(tables, f))[1] == brute.facilities(expected["aqu"], f)


@pytest.mark.parametrize("f", CHOSEN, ids=str)
def test_enforcement_report(tables, expected, f):
    everything = [r for rows in expected.values() for r in rows]
    assert got(R.t08_enforcement(tables, f))[1] == brute.enforcement(
        expected["patrol"], everything, CHOICES, f)


@pytest.mark.parametrize("f", [CHOSEN[2], CHOSEN[4], CHOSEN[7]], ids=str)
def test_bundle_gives_the_same_tables(tables, f):
    bundle = report_bundle(tables, f)
    assert set(bundle) == set(R.REPORTS) - {"t07_aquaculture_detail"}
    for name, table in bundle.items():
        assert got(table) == got(R.REPORTS[name](tables, f)), name


def test_code_summary(tables):
    # this report labels provinces only, so a species with two labels counts once
    rows = brute.join(nan_is_missing(AQU), CHOICES, "provinces", "province", "kh", "en")
    sums, totals = {}, {}
    for r in rows:
        if r["catch"] is not None and r["catch"] > 0:
            key = r["kh"], r["fish_code"]
            sums[key] = sums.get(key, 0) + r["catch"]
            totals[r["kh"]] = totals.get(r["kh"], 0) + r["catch"]
    ranked = sorted(totals, key=lambda p: (-totals[p], brute.last(p)))
    long = [
        (i + 1, p, c, sums[p, c], totals[p])
        for i, p in enumerate(ranked)
        for c in sorted((c for q, c in sums if q == p), key=brute.last)
    ]
    assert got(R.aqu_code_summary(tables, wide=False))[1] == long
    columns, wide = got(R.aqu_code_summary(tables))
    assert columns[:2] == [D.ROW_NUMBER_HEADING, D.PROVINCE_OR_CAPITAL] and columns[-1] == D.TOTAL
    assert [r[1] for r in wide] == ranked and [r[0] for r in wide] == list(range(1, len(ranked) + 1))
    for r in wide:
        assert sum(r[2:-1]) == r[-1] == totals[r[1]]


def test_facilities_without_a_type_column(tables):
    other = SurveyTables(lambda name: None, tables.codes)
    other.aquaculture = tables.aquaculture.drop("aqu_type")
    columns, rows = got(R.t10_facilities(other, Filters()))
    assert columns == ["province_kh", "plastic soung", "ponds", "batches"]
    assert rows == [(p, 0, 0, 0) for p in D.PROVINCES]


def test_top_is_a_prefix_of_the_whole_order(tables, expected):
    columns, rows = brute.species(expected["capture"], Filters(), False)
    assert [r[-1] for r in rows] == sorted((r[-1] for r in rows), reverse=True)
    detail = got(R.t06_species_detail(tables))[1]
    total = sum(r[-1] for r in detail)
    assert total == sum(
        brute.rint(r["catch"]) for r in expected["capture"]
        if r["date"] and (brute.rint(r["catch"]) or 0) > 0)
