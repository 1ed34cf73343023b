"""From landed JSON to written sheets."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.operators.filters import Filters
from fieldtally.operators.lookups import Codebook
from fieldtally.plans import clean, enrich
from fieldtally.plans import options as O
from fieldtally.plans import reports as R
from fieldtally.plans.bundle import report_bundle
from fieldtally.plans.typed import SurveyTables
from fieldtally.session import LISTING, listed, settle, shared_folder
from fieldtally.sources import pages, sinks, staging
from fieldtally.sources.pages import page_elements
from fieldtally.sources.warehouse import Warehouse
from fieldtally.sources.submissions import (
    SUBMISSION,
    find_schema,
    latest_versions,
    read_pages,
    read_submissions,
    set_aside,
    stage_submissions,
)
from fieldtally.streaming import landing


def submission(i, province, date, **groups):
    return {
        "_id": i, "province": province, "date": date, "inspectorate": "3",
        "_submission_time": f"{date}T08:00:00", "_status": "submitted", "formhub/uuid": "u",
        "_validation_status": {"label": "ok"}, "_tags": [], "notes": "n",
    } | groups


def caught(catch, area, kind, fish):
    names = ("nat_catch", "area_nat", "type_fishing", "nat_fishtype")
    return {f"nat_fishcatch/{n}": v for n, v in zip(names, (catch, area, kind, fish)) if v is not None}


def grown(catch, area, kind, fish):
    names = ("aqu_catch", "area_aqu", "aqu_type", "aqu_fishtype")
    return {f"aqu_fishcatch/{n}": v for n, v in zip(names, (catch, area, kind, fish)) if v is not None}


SUBMISSIONS = [
    submission(1, "1", "2024-01-05",
               nat_fishcatch=[caught("10.5", "1", "3", "40"), caught(7, "1", "3", None), caught("x", "1", "3", "")],
               aqu_fishcatch=[grown("2.5", "1", "Ponds_batch", "78")]),
    submission(2, "7", "2023-02-20", nat_fishcatch=[caught("100", "2", "1", "41")],
               patrol=[{"patrol/amount": "4", "patrol/enforcement": ["2", "6"]}, {"patrol/enforcement": "3 3"}]),
    submission(3, "08", "2024-03-31", nat_fishcatch=[], processing=[
        {"processing/amountprocessing": "12", "processing/typeprocessing": "1", "processing/area_pro": "2"}]),
    submission(4, None, None, nat_fishcatch=[caught("5", "1", "3", "40")]),
    submission(5, "8", "2024-03-01", nat_fishcatch=[caught("3.5", "1", "1", "40"), caught("-2", "1", "1", "40")]),
]
CHOICES = [("provinces", str(i + 1), p, f"P{i + 1:02}") for i, p in enumerate(D.PROVINCES)] + [
    ("type", "40", "trey", "Fish"), ("typepro", "1", "smoked", "Smoked"),
    ("area", "1", "sab", "Inland Fresh"), ("area", "2", "samot", "Marine"),
]


@pytest.fixture(scope="module")
def codes(spark):
    return Codebook(spark.createDataFrame(
        CHOICES, "list_name string, name string, label_khmer string, label_english string"))


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    (folder / "pages").mkdir()
    (folder / "lines").mkdir()
    for n, part in enumerate((SUBMISSIONS[:2], SUBMISSIONS[2:])):
        results = ",\n".join(json.dumps(s) for s in part)
        page = f'{{"count": {len(part)},\n"next": null,\n"results": [{results}]}}'
        (folder / "pages" / f"{n}.json").write_text(page)
        lines = "\n".join(json.dumps(s) for s in part)
        (folder / "lines" / f"{n}.json").write_text(lines)
    return folder


@pytest.fixture(scope="module")
def submissions(spark, landed):
    read = read_submissions(spark, str(landed / "pages"))
    return stage_submissions(read, str(landed / "staged"))


def survey(cleaned, codes):
    return SurveyTables.of_cleaned(
        codes, capture=cleaned.nat, aquaculture=cleaned.aqu, processing=cleaned.processing,
        patrol=cleaned.patrol)


@pytest.fixture(scope="module")
def tables(submissions, codes):
    return survey(clean.clean_all(submissions), codes)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pages_and_lines_read_the_same(spark, landed, submissions):
    lines = read_submissions(spark, str(landed / "lines"), lines=True)
    assert sorted(rows(lines), key=str) == sorted(rows(submissions), key=str)
    assert submissions.count() == 5


def test_a_page_without_results_fails_and_an_empty_one_does_not(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "0.json").write_text('{"results": []}')
    assert read_submissions(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "0.json").write_text('{"detail": "not found"}')
    with pytest.raises(Exception, match="no results"):
        read_submissions(spark, str(tmp_path / "other")).count()


BAD_LINES = {
    "torn": '{"_id": 7, "date": "2024-01-0',
    "wrong_group": '{"_id": 7, "date": "2024-01-05", "nat_fishcatch": "none"}',
    "wrong_id": '{"_id": "abc", "date": "2024-01-05"}',
    "no_object": "7",
}


def with_bad_line(folder, bad, page):
    good = [json.dumps(s) for s in SUBMISSIONS[:2]]
    folder.mkdir()
    if page:
        (folder / "good.json").write_text(f'{{"results": [{", ".join(good)}]}}')
        (folder / "bad.json").write_text(f'{{"results": [{bad}]}}')
    else:
        (folder / "good.json").write_text(good[0] + "\n\n")
        (folder / "bad.json").write_text(f"{good[1]}\n{bad}\n")


@pytest.mark.parametrize("page", [False, True])
@pytest.mark.parametrize("kind", list(BAD_LINES))
def test_what_cannot_be_read_fails_or_is_set_aside(spark, tmp_path, kind, page):
    folder, rejects = tmp_path / "in", str(tmp_path / "rejects")
    with_bad_line(folder, BAD_LINES[kind], page)
    for ask in (lambda df: df.count(), lambda df: df.select("date").collect(), lambda df: df.collect()):
        with pytest.raises(Exception, match="can't be read in .*bad.json"):
            ask(read_submissions(spark, str(folder), lines=not page))
    kept = read_submissions(spark, str(folder), lines=not page, rejects=rejects)
    assert sorted(r[0] for r in kept.select("_id").collect()) == [1, 2]
    (aside,) = spark.read.parquet(rejects).collect()
    assert aside.file.endswith("bad.json") and BAD_LINES[kind].replace(" ", "") in aside.text.replace(" ", "")
    assert aside.pos == (0 if page and kind != "torn" else None)
    assert set_aside(spark, str(folder), rejects, lines=not page) == 1


def test_a_page_keeps_its_good_submissions(spark, tmp_path):
    folder, rejects = tmp_path / "in", str(tmp_path / "rejects")
    folder.mkdir()
    mixed = [json.dumps(SUBMISSIONS[0]), BAD_LINES["wrong_group"], "null", json.dumps(SUBMISSIONS[1]), BAD_LINES["no_object"]]
    (folder / "0.json").write_text(f'{{"results": [{", ".join(mixed)}]}}')
    (folder / "1.json").write_text('{"detail": "not found"}')
    (folder / "2.json").write_text('{"results": []}')
    kept = read_submissions(spark, str(folder), rejects=rejects)
    assert sorted(r[0] for r in kept.select("_id").collect()) == [1, 2]
    aside = sorted((r.file[-6:], r.pos, json.loads(r.text)) for r in spark.read.parquet(rejects).collect())
    assert aside == [("0.json", 1, json.loads(BAD_LINES["wrong_group"])), ("0.json", 4, 7), ("1.json", None, {"detail": "not found"})]
    again = read_submissions(spark, str(folder / "0.json"), rejects=rejects)
    whole = read_submissions(spark, with_page(tmp_path, SUBMISSIONS[:2]))
    assert sorted(rows(again), key=str) == sorted(rows(whole), key=str)


def with_page(folder, submissions):
    (folder / "good").mkdir()
    (folder / "good" / "0.json").write_text(json.dumps({"results": submissions}))
    return str(folder / "good")


@pytest.mark.parametrize(("kind", "parses"), [("lines", 1), ("pages", 2)])  # a page once more, to take it apart
def test_json_is_parsed_once(spark, landed, kind, parses):
    read = read_submissions(spark, str(landed / kind), lines=kind == "lines")
    for df in (read, read.select("date"), read.where(F.col("date") > "2024"), read.groupBy().count()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == parses, plan


NASTY = [
    submission(11, 'a "quoted" {brace} \\ [x] }', "2024-01-05", nat_fishcatch=[caught("1", "1", "3", "}{")]),
    submission(12, "ends with a backslash \\", "2024-01-06", remarks="}]}", nat_fishcatch=[]),
    submission(13, "ខ្មែរ } ពោធិ៍សាត់", "2024-01-07", nat_fishcatch=[caught("\n}", "2", "1", '"')]),
]


@pytest.mark.parametrize("size", [20, 333, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_pages_are_cut_by_byte_ranges(spark, tmp_path, monkeypatch, size, indent):
    folder = tmp_path / "in"
    folder.mkdir()
    given = [*SUBMISSIONS, *NASTY]
    for n, part in enumerate((given, given[:1], [])):
        page = {"count": len(part), "next": None, "note": "a } and ] and {", "results": part, "more": {"a": {"b": []}}}
        (folder / f"{n}.json").write_text(json.dumps(page, indent=indent, ensure_ascii=False) + "\n" * n)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, size)
        cut = read_pages(spark, str(folder))
        found = sorted(rows(cut), key=str)
        if size == 333:
            assert page_elements(spark, str(folder)).select("file").distinct().count() == 2
            assert spark.read.text(str(folder), lineSep="}").rdd.getNumPartitions() > 10
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == sorted(rows(read_submissions(spark, str(folder))), key=str) and len(found) == 9


@pytest.mark.parametrize(("page", "fault", "good"), [
    ('{"results": [{"_id": 1}, {"_id": 2', "can't be read", [0]),
    ('{"results": [{"_id": 1}, {"_id": 2}', None, [0, 1]),
    ('{"detail": "not found"}', "no results", []),
    ('{"results": [7, {"_id": 1}, null, {"_id": 2}, "x"]}', "no submissions", [0, 1]),
    ('{"results": []}', None, []),
    ("", None, []),
])
def test_what_large_pages_hold(spark, tmp_path, page, fault, good):
    (tmp_path / "0.json").write_text(page)
    found = page_elements(spark, str(tmp_path)).collect()
    assert sorted(r.pos for r in found if r.page is None) == good
    assert all(json.loads(r.text)["_id"] == r.pos + 1 for r in found if r.page is None)
    faults = {r.page for r in found if r.page}
    assert bool(faults) == bool(fault) and all(fault in f for f in faults)
    if fault:
        with pytest.raises(Exception, match=f"{fault}.*0.json"):
            read_pages(spark, str(tmp_path)).count()


def test_large_pages_are_read_once_and_counted_once(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"results": SUBMISSIONS}))
    found = page_elements(spark, str(tmp_path))
    assert found.count() == len(SUBMISSIONS)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan text") == 2


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_pages_in_blocks_of_any_size(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(pages, "BLOCK_BITS", bits)
    given = [{"_id": i, "a": [{"b": "}" * i + '\\" {['}, {}], "c": {"d": [[], {"e": {}}]}} for i in range(12)]
    (tmp_path / "0.json").write_text(json.dumps({"note": '"}]', "results": given, "more": {}}) + "\n")
    found = page_elements(spark, str(tmp_path)).collect()
    assert [json.loads(r.text) for r in sorted(found, key=lambda r: r.pos)] == given
    assert [r.page for r in found] == [None] * 12


def test_folders_are_listed_by_few_tasks(spark):
    before, seen = spark.conf.get(LISTING), []
    listed(spark, lambda: seen.append(int(spark.conf.get(LISTING))))
    assert seen[0] <= 4 * spark.sparkContext.defaultParallelism < int(before) and spark.conf.get(LISTING) == before


def test_rejects_are_written_small(spark, tmp_path):
    """Both what is set aside and the submissions beside it are compressed by zstd, whatever the session's codec."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("".join(json.dumps(s) + "\n" for s in SUBMISSIONS) + "torn\n")
    good = read_submissions(spark, str(tmp_path / "in"), lines=True, rejects=str(tmp_path / "out"))
    files = [*good.inputFiles(), *spark.read.parquet(str(tmp_path / "out")).inputFiles()]
    assert files and all("zstd" in f for f in files)


def changed(i, **answers):
    return SUBMISSIONS[i] | answers


def test_the_latest_version_counts(spark, tmp_path):
    earlier = [changed(0, province="9", _submission_time="2024-01-04T08:00:00"), changed(1, province="9", _submission_time=None)]
    later = [changed(2, province="10", _submission_time="2025-01-01T00:00:00"), changed(3, date="2024-05-05", _submission_time="x")]
    unnamed = [{"date": "2024-01-01"}, {"date": "2024-01-01"}, {"date": "2024-01-02"}]
    for n, part in enumerate((earlier, SUBMISSIONS, later, unnamed, SUBMISSIONS[:1])):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(s) for s in part))
    found = latest_versions(read_submissions(spark, str(tmp_path), lines=True))
    assert found.columns == list(SUBMISSION.names)
    provinces = sorted(((r._id or 0, r.province) for r in found.where("_id < 4 OR _id = 5 OR _id IS NULL").collect()), key=str)
    assert provinces == [(0, None), (0, None), (1, "1"), (2, "7"), (3, "10"), (5, "8")]
    assert found.where("_id = 4").count() == 1  # neither time can be read: one of the two, always the same
    assert found.where("_id = 4").collect() == latest_versions(read_submissions(spark, str(tmp_path), lines=True).repartition(3)).where("_id = 4").collect()


def test_a_stream_stops_at_what_cannot_be_read_or_keeps_it_apart(spark, tmp_path):
    folder, at = tmp_path / "in", lambda name: str(tmp_path / name)
    folder.mkdir()
    (folder / "0.json").write_text("\n".join([json.dumps(SUBMISSIONS[0]), *BAD_LINES.values()]))
    with pytest.raises(Exception, match="can't be read in .*0.json"):
        landing.land(spark, str(folder), at("staged"), at("strict")).awaitTermination()
    landing.land(spark, str(folder), at("kept"), at("lax"), skip_bad=True).awaitTermination()
    assert spark.read.parquet(at("kept")).count() == 1
    for _ in range(2):
        landing.land_rejects(spark, str(folder), at("rejects"), at("lax")).awaitTermination()
    assert {r.text for r in spark.read.parquet(at("rejects")).collect()} == set(BAD_LINES.values())


def test_every_answer_is_found(spark, tmp_path):
    more = SUBMISSIONS[0] | {"remarks": "n", "law/extra": 3, "boat": {"Length": 2.5}, "names": ["a", 1]}
    (tmp_path / "0.json").write_text("\n".join(json.dumps(s) for s in (SUBMISSIONS[1], more)))
    schema = find_schema(spark, str(tmp_path), lines=True)
    assert schema.fields[: len(SUBMISSION.fields)] == SUBMISSION.fields
    main = clean.clean_main(read_submissions(spark, str(tmp_path), lines=True, schema=schema))
    found = {r.id: r for r in main.collect()}
    assert (found[1].law_extra, found[1].boat_length, found[2].law_extra, found[1].remarks) == ("3", "2.5", "null", "n")
    assert "formhub_uuid" not in main.columns
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "0.json").write_text(json.dumps({"results": [more]}))
    assert set(find_schema(spark, str(tmp_path / "pages")).names) == set(schema.names)


def test_cleaned_tables(submissions):
    tables = clean.clean_all(submissions)
    main = {r["id"]: r for r in tables.main.collect()}
    assert set(main) == {1, 2, 3, 4, 5}
    assert main[3]["province"] == 8 and main[4]["province"] is None
    assert main[4]["date"] == "null" and main[1]["submission_time"] == "2024-01-05 08:00:00"
    assert not {"status", "tags", "validation_status_label", "nat_fishcatch"} & set(tables.main.columns)
    nat = sorted(rows(tables.nat.select(
        "id", "pos", "nat_fishcatch_nat_catch", "nat_fishcatch_nat_fishtype", "province")))
    assert nat == [
        (1, 0, "10.5", "40", "1"), (1, 1, "7", "unspecified", "1"), (1, 2, "x", "null", "1"),
        (2, 0, "100", "41", "7"), (4, 0, "5", "40", "unspecified"), (5, 0, "3.5", "40", "8"),
        (5, 1, "-2", "40", "8")]
    patrol = rows(tables.patrol.select("pos", "patrol_amount", "patrol_enforcement").orderBy("pos"))
    assert patrol == [(0, "4", "2,6"), (1, "null", "3 3")]


def test_sentinels_become_labels_and_measures_stay_missing(submissions, codes):
    capture = enrich.enrich_capture(clean.clean_capture(submissions), codes)
    got = sorted(rows(capture.select("id", "pos", "catch", "fish_name_kh", "province_kh", "week")))
    assert got[1][3] == "unspecified" and got[2][2] is None and got[2][3] == "null"
    assert [r for r in got if r[0] == 4] == [(4, 0, 5.0, "trey", "unspecified", "WeekNA")]
    processing = enrich.enrich_processing(clean.clean_processing(submissions), codes)
    assert rows(processing.select("processing_amount", "province_kh", "province_group", "proc_name_en")) == [
        (12.0, "08", "Inland", "Smoked")]
    main = enrich.enrich_submissions(clean.clean_main(submissions), codes)
    assert sorted(rows(main.select("id", "province_en")), key=str)[:3] == [(1, "P01"), (2, "P07"), (3, "P08")]


def test_reports(tables):
    chosen = Filters(year=2024)
    rice = {r[0]: r[1:] for r in rows(R.t04_rice_field(tables, chosen))}
    assert len(rice) == 25 and rice[D.PROVINCES[0]] == (0, 17) and rice[D.PROVINCES[1]] == (0, 0)
    assert rows(R.t02_dai(tables, chosen)) == [
        (D.PROVINCES[7], 0, 2), (D.PROVINCES[11], 0, 0), (D.PROVINCES[13], 0, 0)]
    assert rows(R.t05_marine_province(tables, chosen)) == [(D.PROVINCES[6], 100, 0)]
    assert rows(R.t06_marine_species(tables, Filters())) == [("41", 100, 100)]
    enforcement = rows(R.t08_enforcement(tables, chosen))
    assert (D.PROVINCES[6], 1, 2, 1) in enforcement
    assert [r[0] for r in enforcement] == [
        "08", D.PROVINCES[0], D.PROVINCES[6], D.PROVINCES[7], "unspecified"]
    ponds = {r[0]: r[1:] for r in rows(R.t10_facilities(tables, chosen))}
    assert ponds[D.PROVINCES[0]] == (0, 1, 1) and len(ponds) == 25


def test_options(tables, codes):
    assert rows(O.years_available(tables.all)) == [(2023,), (2024,)]
    assert rows(O.quarters_available(tables.all)) == [("Q1",)]
    assert rows(O.months_available(tables.all)) == [(1, "January"), (2, "February"), (3, "March")]
    assert rows(O.weeks_available(tables.all)) == [("Week1",), ("Week3",), ("Week5",)]
    assert rows(O.groups_available(tables.all)) == [("Marine",), ("Inland",)]
    provinces = O.provinces_available(tables.all, codes)
    assert [r[1] for r in rows(provinces)] == ["08", "P01", "P07", "P08", "unspecified"]
    assert [r[0] for r in rows(O.areas_available(tables.with_area, codes))] == ["Inland Fresh", "Marine"]
    areas = O.areas_available(tables.with_area, codes)
    assert rows(O.areas_for_group(areas, "Inland")) == [("Inland Fresh",)]
    assert O.areas_for_group(areas, "Marine") is areas
    assert rows(O.months_for_quarter(O.months_available(tables.all), 2)) == []
    assert O.processing_sources(tables.processing).count() == 0
    assert [r[0] for r in rows(O.provinces_for_group(codes, "Marine").orderBy("province_en"))] == [
        "7", "9", "18", "23"]
    assert O.provinces_for_group(codes, None).count() == 25


def test_options_from_facets(tables, codes):
    facets = settle(O.facets(tables.all))
    for one, many in (
        (O.years_available([facets]), O.years_available(tables.all)),
        (O.weeks_available([facets]), O.weeks_available(tables.all)),
        (O.months_available([facets]), O.months_available(tables.all)),
        (O.groups_available([facets]), O.groups_available(tables.all)),
        (O.provinces_available([facets], codes), O.provinces_available(tables.all, codes)),
        (O.areas_available([facets], codes), O.areas_available(tables.with_area, codes)),
    ):
        assert rows(one) == rows(many)


def test_layout_places_columns(frame):
    table = frame([("a", 1, 2, 3)], "province_kh string, `2022` int, `2023` int, `2024` int")
    placed = sinks.report_layout(table, sinks.LAYOUT["t05_marine_province"])
    cells = {f.name: (f.metadata["row"], f.metadata["col"]) for f in placed.schema.fields}
    assert cells == {"province_kh": (8, 2), "2022": (8, 3), "2023": (8, 5), "2024": (8, 6)}
    facilities = sinks.report_layout(frame([("a", 1)], "province_kh string, ponds int"),
                                     sinks.LAYOUT["t10_facilities"])
    assert rows(facilities) == [("a", 1, 0, 0)]
    assert facilities.columns == ["province_kh", "ponds", "batches", "plastic soung"]


def test_bundle_on_disk(spark, tables, tmp_path):
    reports = report_bundle(tables, Filters(year=2024))
    day = datetime.date(2024, 12, 31)
    for _ in range(2):  # a second run of a day replaces the first
        written = sinks.write_report_bundle(reports, str(tmp_path), day)
    assert len(written) == 9
    assert written["t02_dai"].endswith("/T02_ផលឧបករណ៍ដាយ/run_date=2024-12-31")
    dai = spark.read.option("header", True).csv(written["t02_dai"])
    assert dai.columns == ["province_kh", "2023", "2024", "sheet_row"]
    assert rows(dai)[0] == (D.PROVINCES[7], "0", "2", "11")
    assert [r.sheet_row for r in dai.collect()] == ["11", "12", "13"]
    kept = sinks.write_report_bundle({"t02_dai": reports["t02_dai"]}, str(tmp_path / "p"), day, "parquet")
    fields = spark.read.parquet(kept["t02_dai"]).schema.fields
    assert [f.metadata["col"] for f in fields[:-1]] == [2, 3, 5] and fields[-1].name == "sheet_row"


def test_staged_tables_give_the_same_reports(spark, tables, codes, tmp_path):
    staging.stage_tables(tables, str(tmp_path))
    staged = staging.StagedTables(spark, str(tmp_path), codes)
    for report in (R.t04_rice_field, R.t08_enforcement, R.t10_facilities, R.t06_species_detail):
        assert rows(report(staged, Filters(year=2024))) == rows(report(tables, Filters(year=2024)))
    df = R.t04_rice_field(staged, Filters(year=2024))
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().toString()
    assert staged.capture is staged.capture


def scans(df, *folders):
    """How many scans of the optimized plan read each folder, by the roots of their relations."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    roots = [p for leaf in leaves if "Relation" in leaf.nodeName() for p in root_paths(leaf)]
    return {folder: roots.count(folder) for folder in folders}


def root_paths(leaf):
    paths = leaf.relation().location().rootPaths()
    return [paths.apply(i).toUri().getPath() for i in range(paths.size())]


def test_province_lists_need_no_fact_table(spark, tables, codes, tmp_path):
    staging.stage_tables(tables, str(tmp_path))
    staged = staging.StagedTables(spark, str(tmp_path), codes)
    report = R.t08_enforcement(staged, Filters(year=2024))
    report.collect()
    found = scans(report, *(f"{tmp_path}/{n}" for n in (*staging.NAMES, "facets")))
    assert list(found.values()) == [0, 0, 0, 1, 1]
    (tmp_path / "bare").mkdir()
    for name in staging.NAMES:
        staging.stage_table(getattr(tables, name), str(tmp_path / "bare" / name))
    bare = staging.StagedTables(spark, str(tmp_path / "bare"), codes)
    assert rows(R.t08_enforcement(bare, Filters(year=2024))) == rows(report)


def test_landed_files_are_loaded_once(spark, landed, tables, codes, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    checkpoint, parsed = str(tmp_path / "checkpoint"), str(tmp_path / "parsed")

    def load():
        landing.land(spark, str(source), parsed, checkpoint).awaitTermination()
        for name in landing.STEPS:
            landing.load(spark, name, parsed, str(out), checkpoint).awaitTermination()
            landing.load_facets(spark, name, parsed, str(out), checkpoint).awaitTermination()

    for n in (0, 1):
        (source / f"{n}.json").write_text((landed / "lines" / f"{n}.json").read_text())
        load()
    load()  # nothing new
    staged = staging.StagedTables(spark, str(out), codes)
    for name in landing.STEPS:
        kept, typed = getattr(staged, name), getattr(tables, name)
        assert sorted(rows(kept.select(typed.columns)), key=str) == sorted(rows(typed), key=str)
    assert rows(R.t04_rice_field(staged, Filters(year=2024))) == rows(
        R.t04_rice_field(tables, Filters(year=2024)))
    values = staged.offered[0].distinct()
    assert sorted(rows(values), key=str) == sorted(rows(O.facets(tables.all).select(values.columns)), key=str)
    assert len(list(out.glob("capture/year=2024/*.parquet"))) <= 2 * landing.FILES_PER_YEAR


def test_shared_folder_is_the_one_the_cluster_names(spark, tmp_path):
    before = shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert before == named or named is None
    settled = settle(spark.range(5))
    assert settled.count() == 5


def test_versions(spark, tables, codes, tmp_path):
    first = Warehouse(spark, str(tmp_path), codes)
    assert first.is_empty and first.number == 0
    named = {name: getattr(tables, name) for name in staging.NAMES}
    second = first.publish(named)
    for report in R.REPORTS.values():
        for chosen in (Filters(), Filters(year=2024, quarter="Q1"), Filters(group="Inland", year=2024), Filters(month=3, week=5)):
            assert rows(report(second, chosen)) == rows(report(tables, chosen)), (report.__name__, chosen)
    assert rows(R.aqu_code_summary(second)) == rows(R.aqu_code_summary(tables))
    assert sorted(rows(O.provinces_available(second.offered, codes))) == sorted(rows(O.provinces_available(tables.offered, codes)))
    # a reader that began before keeps to what it saw
    before = rows(R.t04_rice_field(second, Filters(year=2024)))
    third = second.publish({n: t.where("year = 2023") for n, t in named.items()}, [2023, 2024])
    assert rows(R.t04_rice_field(second, Filters(year=2024))) == before
    assert third.capture.where("year = 2024").count() == 0 and third.capture.where("year IS NULL").count() == 1
    assert Warehouse(spark, str(tmp_path), codes).number == third.number == 2
    # of two publications at once, one fails and changes nothing
    with pytest.raises(RuntimeError, match="come between"):
        second.publish(named)
    assert Warehouse(spark, str(tmp_path), codes).capture.count() == third.capture.count()
    # folders no recent manifest names go
    assert third.clear(keep=1) > 0 and third.clear(keep=1) == 0
    assert rows(third.capture) == rows(Warehouse(spark, str(tmp_path), codes).capture)


def test_reports_read_kept_sums_alone(spark, tables, codes, tmp_path):
    kept = Warehouse(spark, str(tmp_path), codes).publish({name: getattr(tables, name) for name in staging.NAMES})
    folders = [f"{tmp_path}/data/{n}/" for n in staging.NAMES]
    for report in [*R.REPORTS.values(), R.aqu_code_summary]:
        df = report(kept, Filters(year=2024)) if report in R.REPORTS.values() else report(kept, wide=False)
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves = [leaves.apply(i) for i in range(leaves.size())]
        read = [p for leaf in leaves if "Relation" in leaf.nodeName() for p in root_paths(leaf)]
        assert not any(p.startswith(tuple(folders)) for p in read), report.__name__


def land_more(folder, n, submissions):
    (folder / f"{n:02}.json").write_text("\n".join(json.dumps(s) for s in submissions))


def test_a_stream_keeps_the_latest_versions(spark, codes, tmp_path):
    """Edited, repeated and late submissions, a move to another year, a restart between and a batch that is repeated."""
    folder, at = tmp_path / "in", lambda name: str(tmp_path / name)
    folder.mkdir()

    def run():
        landing.land(spark, str(folder), at("staged"), at("state")).awaitTermination()
        landing.merge(spark, at("staged"), at("tables"), at("state"), codes).awaitTermination()
        return Warehouse(spark, at("tables"), codes)

    def expected():
        read = latest_versions(read_submissions(spark, str(folder), lines=True))
        return survey(clean.clean_all(read), codes)

    later = {"_submission_time": "2026-01-01T00:00:00"}
    steps = [
        SUBMISSIONS[:3],
        [*SUBMISSIONS[2:], changed(0, province="9", **later)],
        [changed(1, date="2024-02-20", **later), SUBMISSIONS[0]],  # to another year; an old version again
        [changed(1, date="2022-02-20", _submission_time="2020-01-01T00:00:00")],  # late, and older
    ]
    for n, part in enumerate(steps):
        land_more(folder, n, part)
        found = run()
        for name in staging.NAMES:
            assert sorted(rows(getattr(found, name)), key=str) == sorted(rows(getattr(expected(), name).select(*getattr(found, name).columns)), key=str)
        for report in (R.t04_rice_field, R.t05_marine_province, R.t08_enforcement, R.t10_facilities):
            assert rows(report(found, Filters(year=2024))) == rows(report(expected(), Filters(year=2024))), (n, report.__name__)
    assert run().number == found.number == len(steps)
    versions = sum(1 for _ in (tmp_path / "tables" / "data" / "capture").glob("version=*"))
    assert versions <= 6 and found.batches == {"merge": len(steps) - 1}
