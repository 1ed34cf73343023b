"""Language identification and the quality classifier: held-out accuracy, exact votes, edges."""

import numpy as np
import pytest
from cases import TEXTS, documents, no_documents
from check import TESTDATA
from pyspark.sql import functions as F

from fieldtally.llm import language, quality
from fieldtally.llm.common import held_out, table
from fieldtally.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SMALL = TESTDATA / "sf0.001"


def test_language_on_held_out(spark):
    found = QUERIES["op2_language"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # what is accepted is right more often than what is not
    assert np.mean([r.lang == r.lang_pred for r in rows if r.accepted]) >= np.mean([r.lang == r.lang_pred for r in rows])


def test_subwords_stay_inside_words():
    (owners, places, buckets), = language.subwords(["ab, cd", "", "AB"])
    of = {o: sorted(buckets[places == i].tolist()) for i, o in enumerate(owners)}
    (_, _, alone), = language.subwords(["ab"])
    (_, _, other), = language.subwords(["cd"])
    assert of[2] == sorted(alone.tolist()) and of.get(1, []) == []
    assert of[0] == sorted([*alone.tolist(), *other.tolist()])


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = "el perro y the dog " * 50
    whole = np.concatenate([b for _, _, b in language.subwords([text])])
    monkeypatch.setattr(language, "slices", lambda t: __import__("fieldtally.llm.characters", fromlist=["x"]).slices(t, 37))
    cut = np.concatenate([b for _, _, b in language.subwords([text])])
    assert sorted(whole) == sorted(cut)


def test_language_edges(spark):
    docs = documents(spark)
    labelled = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the house and dog", "en"), ("das haus und hund", "de")] * 20)], "doc_id long, text string, lang string")
    model = language.fit(labelled)
    assert model.languages == ["de", "en"]
    for row in language.identify(docs, model).collect():
        if row.doc_id is not None and not any(c.isalpha() for c in TEXTS[row.doc_id] or ""):
            assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
        elif row.doc_id is not None:
            assert row.lang_pred in ("de", "en") and 0 < row.score <= 1
    assert language.fit(no_documents(spark)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(no_documents(spark), model).count() == 0


def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = QUERIES["op8_quality"](spark, FOLDER)
    assert found.count() == 1000
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_votes_are_exact(monkeypatch):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(60, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = draw.integers(0, 2, 60).astype(np.float32)
    model = quality.Model(None, None, None, vectors, labels, float(labels.mean()))
    asked = draw.normal(size=(20, 5))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    for vector, found in zip(asked, quality.votes(model, asked)):
        cosines = sorted(((float(vector @ v), l) for v, l in zip(vectors, labels)), reverse=True)[: quality.NEIGHBOURS]
        weights = [np.exp(quality.SHARPNESS * (c - 1)) for c, _ in cosines]
        expected = (sum(w * l for w, (_, l) in zip(weights, cosines)) + model.prior * 1e-3) / (sum(weights) + 1e-3)
        assert abs(found - expected) < 1e-6


def test_features_are_of_one_text_alone():
    texts = ["", "A | b\n", "", "x" * 50, "The THE the!!", "12 é"]
    together = quality.features(texts)
    assert all((quality.features([t])[0] == row).all() for t, row in zip(texts, together))


def test_quality_by_wording_alone(spark):
    """Texts of equal layout, repetition and word lengths, whose labels only their words tell."""
    draw = np.random.default_rng(5)
    words = ["".join(draw.choice(list("abcdefghijkl"), 5)) for _ in range(300)]
    own = [words[100:200], words[200:]]
    rows = [(i, " ".join(draw.permutation([*draw.choice(words[:100], 24), *draw.choice(own[i % 2], 6)])), i % 2) for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = quality.score(docs.where("doc_id >= 300"), quality.fit(docs.where("doc_id < 300"))).collect()
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in found]) > 0.9


def test_quality_edges(spark):
    docs = documents(spark)
    labelled = docs.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    for model in (quality.fit(labelled), None):
        rows = quality.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        kept = quality.keep_good(docs, model, 0.0)
        assert kept.columns == docs.columns and kept.count() == docs.count()
    by_text = {}
    for row, score in zip(docs.collect(), quality.score(docs, quality.fit(labelled)).collect()):
        assert by_text.setdefault(row.text or "", score.score) == score.score
    assert quality.fit(no_documents(spark).withColumn("quality", F.lit(1))) is None
    assert quality.score(no_documents(spark), None).count() == 0


def test_language_is_the_softmax_of_the_mean_embedding(spark):
    """Predictions against a mean over subwords one by one."""
    labelled = table(spark, str(SMALL), "documents").limit(60)
    model = language.fit(labelled)
    given = ["Ein Haus, und noch ein Haus", "x", "many words " * 40, "é ß", "the house of the many"]
    for text, found in zip(given, language.predict(model, given)):
        buckets = np.concatenate([b for _, _, b in language.subwords([text])])
        logits = (np.mean([model.table[b] for b in buckets], axis=0) + model.bias) / model.temperature
        expected = np.exp(logits - logits.max())
        assert found == pytest.approx(expected / expected.sum(), abs=1e-6)


def test_held_out_languages_are_not_learned(spark):
    """Other labels in the held-out third leave the model as it is."""
    docs = table(spark, str(SMALL), "documents")
    changed = docs.withColumn("lang", F.when(held_out(), F.lit("other")).otherwise(F.col("lang")))
    found = [language.fit(d.where(~held_out())) for d in (docs, changed)]
    assert found[0].languages == found[1].languages and (found[0].table == found[1].table).all()


def test_shares_are_the_rows_of_a_matrix():
    draw = np.random.default_rng(4)
    buckets = [np.sort(draw.choice(language.BUCKETS, n, replace=False)).astype(np.int32) for n in (3, 0, 50)]
    shares = [draw.random(len(b)).astype(np.float32) for b in buckets]
    found = language.Shares(buckets, shares)[np.array([2, 1, 0, 2])]
    assert found.shape == (4, language.BUCKETS)
    for row, i in zip(found, (2, 1, 0, 2)):
        assert (row[buckets[i]] == shares[i]).all() and (row > 0).sum() == len(buckets[i])
