"""How much is written, shuffled and held by a task."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from check import TESTDATA
from fieldtally.registry import ingest
from fieldtally.sources import star, warehouse
from fieldtally.sources.pages import page_elements
from fieldtally.sources.submissions import latest_versions, read_submissions

SF = str(TESTDATA / "sf0.001")


def files(folder):
    return [f for f in folder.rglob("part-*") if f.is_file()]


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "landing_folder", lambda spark: str(tmp_path / "landed"))
    return tmp_path


def test_landed_lines_take_little_disk(spark, shared):
    ingest.landed_lines(spark, SF)
    landed = files(shared)
    lines = b"".join(gzip.decompress(f.read_bytes()) for f in landed)
    assert len(lines.splitlines()) == star.submissions(spark, SF).count()
    assert sum(f.stat().st_size for f in landed) < len(lines) / 8


def test_landed_pages_hold_each_submission_in_its_place(spark, shared):
    ingest.landed_pages(spark, SF)
    landed = files(shared)
    texts = [gzip.decompress(f.read_bytes()) for f in landed]
    assert sum(f.stat().st_size for f in landed) < sum(map(len, texts)) / 8
    ids = [[s["_id"] for s in json.loads(t)["results"]] for t in texts]
    assert all(page == sorted(page) and len({i // 2000 for i in page}) == 1 for page in ids)
    assert sorted(sum(ids, [])) == sorted(r[0] for r in star.submissions(spark, SF).select("_id").collect())


PAGES = [
    '{"results": [{"_id": 1}, {"_id": 2}]}',
    '{"results": [{"_id": 1}, {"_id": 2}]}\n',
    '{"results": [{"_id": 1}, {"_id": 2}',
    '{"results": [{"_id": 1}, {"_id": 2',
    '{"results": [{"_id": "}{"}, {"_id": 2}], "more": {}}',
]


def test_compressed_pages_end_where_plain_ones_do(spark, tmp_path):
    found = {}
    for kind, packed in (("json", lambda text: text), ("json.gz", gzip.compress)):
        (tmp_path / kind).mkdir()
        for n, page in enumerate(PAGES):
            (tmp_path / kind / f"{n}.{kind}").write_bytes(packed(page.encode()))
        number = F.regexp_extract("file", r"(\d+)\.json", 1).alias("file")
        found[kind] = sorted(page_elements(spark, str(tmp_path / kind)).select(number, "pos", "page", "text").collect(), key=str)
    assert found["json"] == found["json.gz"] and len(found["json"]) == 10


def test_the_latest_version_carries_only_the_columns_asked_for(spark, tmp_path):
    lines = [
        {"_id": i % 3 or None, "date": f"2024-01-0{i}", "_submission_time": t, "nat_fishcatch": [{"nat_fishcatch/nat_catch": str(i)}]}
        for i, t in ((1, "2024-01-01"), (1, "2024-01-01"), (2, None), (4, "2024-01-01"), (5, "2023-01-01"), (6, None), (9, None))
    ]
    (tmp_path / "0.json").write_text("\n".join(map(json.dumps, lines)))
    read = read_submissions(spark, str(tmp_path), lines=True)
    few = latest_versions(read, ["_id", "date"])
    assert sorted(few.collect(), key=str) == sorted(latest_versions(read).select("_id", "date").collect(), key=str)
    dealt = few._jdf.queryExecution().optimizedPlan().toString().splitlines()[1]
    assert "Aggregate" in dealt and "nat_fishcatch" not in dealt.split("max_by")[1].split("xxhash64")[0]


def test_cells_of_a_year_are_written_by_several_tasks(spark, tmp_path):
    cells = spark.range(60_000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit(2024).alias("year"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        warehouse._small(cells, str(tmp_path / "out"))
    finally:
        spark.conf.set(key, before)
    assert len(files(tmp_path / "out" / "year=2024")) > 3
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 60_000
