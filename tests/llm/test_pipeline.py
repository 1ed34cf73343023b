"""The pipeline, stage by stage, against plain Python."""

import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import TEXTS, documents, no_documents, sorted_rows
from test_rows import SMALL, hits, smallest_linked
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fieldtally.llm import decontaminate, line_dedup, quality
from fieldtally.llm.common import BATCH_ROWS, table, written
from fieldtally.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, over the small tables."""
    docs, out = table(spark, str(SMALL), "documents"), {}
    for name, stage in pipeline.STAGES:
        given, docs = docs, written(stage(spark, docs, str(SMALL)))
        out[name] = given, docs
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_registered():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_duplicates", "decontamination", "bpe_encoding"]
    assert entry.queries()["pipeline"] is pipeline.run


def test_all_but_the_last_keep_the_columns(stages):
    for name, (given, kept) in list(stages.items())[:-1]:
        assert kept.columns == given.columns, name


def test_rejected_documents_go(spark, stages):
    given, kept = stages["quality_classifier"]
    good = QUERIES["op8_quality"](spark, str(SMALL)).where("predicted = 1").select("doc_id")
    assert set(texts_of(kept)) == {r[0] for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(SMALL / "labels.parquet")).collect()}
    clean = [i for i in texts_of(given) if labels.get(i) == 1]
    assert sum(i in texts_of(kept) for i in clean) > 0.97 * len(clean)


def test_lines_of_many_sources_stay_once(stages):
    given, kept = stages["line_dedup"]
    rows = sorted((r.doc_id, r.source, r.text) for r in given.collect())
    sites, seen, expected = defaultdict(set), set(), {}
    for _, source, text in rows:
        for line in text.split("\n"):
            sites[line.strip(" \t\r\f\v")].add(source)
    for doc_id, _, text in rows:
        left = []
        for line in text.split("\n"):
            key = line.strip(" \t\r\f\v")
            common = len(sites[key]) >= line_dedup.MIN_SITES and len(key.split()) >= line_dedup.MIN_WORDS
            if not common or key not in seen:
                left.append(line)
            if common:
                seen.add(key)
        if left == text.split("\n") or "\n".join(left).strip():
            expected[doc_id] = "\n".join(left)
    assert texts_of(kept) == expected
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_one_of_each_class_stays(stages):
    given, kept = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert set(texts_of(kept)) == {c if n else i for i, n, c in smallest_linked(rows, 5, 80)}
    assert texts_of(kept).items() <= texts_of(given).items()


def test_benchmark_words_are_gone(spark, stages):
    given, kept = stages["decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(str(SMALL / "benchmark.parquet")).collect()]
    before, after = texts_of(given), texts_of(kept)
    assert set(before) == set(after)
    for doc_id, text in before.items():
        n, hit, _ = hits(text, items, 10)
        assert hits(after[doc_id], [], 10)[0] == n - len(hit)
        if not hit:
            assert after[doc_id] == text


def test_ids_are_the_librarys(spark, stages):
    given, kept = stages["bpe_encoding"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(given)
    for row in kept.collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert bytes(row.ids) == struct.pack(f"<{len(ids)}I", *ids)
    again = pipeline.run(spark, str(SMALL))
    assert sorted_rows(again, "doc_id", "n_tokens") == sorted_rows(kept, "doc_id", "n_tokens")


@pytest.mark.parametrize("make", [documents, no_documents])
def test_edges(spark, make):
    docs = make(spark).select("doc_id", "text", "lang", "source", "n_chars", "key", "here")
    kept = docs
    for name, stage in pipeline.STAGES:
        kept = written(stage(spark, kept, str(SMALL)))
        if name != "bpe_encoding":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    if make is documents:
        assert kept.count() <= len(TEXTS) + 3
    else:
        assert kept.count() == 0


def test_python_is_handed_few_texts_at_once(spark, tmp_path):
    """Stages are computed when they are written, so what they hand to Python is bounded by the session."""
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "s", 9) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get(BATCH_ROWS)
    try:
        for stage in (pipeline.quality_classifier, pipeline.decontamination, pipeline.bpe_encoding):
            spark.conf.set(BATCH_ROWS, 10_000)
            assert stage(spark, docs, str(tmp_path)).count() == 3
            assert int(spark.conf.get(BATCH_ROWS)) <= 500
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_quality_works_on_few_texts_at_once(spark, monkeypatch):
    seen, features = [], quality.features
    monkeypatch.setattr(quality, "features", lambda block: seen.append(len(block)) or features(block))
    model = quality.train(features([f"text {i} " * (i + 1) for i in range(30)]), np.arange(30).astype(np.float32) % 2)
    texts = [f"{i} other words" for i in range(300)]
    scores = quality.score_batches(spark, model)(pa.record_batch({"text": texts}))
    assert len(scores) == 300 and max(seen) <= 64
    assert sum(x.nbytes for x in quality.run_buckets()) < 5 << 20


def test_a_task_takes_one_worker_of_python(spark, monkeypatch):
    """An executor keeps its Python workers for the next stages, and each takes up what these need."""
    docs = spark.createDataFrame([(i, "some words of a benchmark item stand in a text " * i) for i in range(4)], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", "words of a benchmark item"), ("b", "stand in"), ("c", "nowhere")], "item_id string, text string")
    whole = sorted_rows(decontaminate.decontaminate(docs, benchmark), "*")
    assert [t for _, t in whole][1] != "some words of a benchmark item stand in a text "
    for block in (decontaminate.BLOCK, 12):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = decontaminate.decontaminate(docs, benchmark)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted_rows(found, "*") == whole
