"""Near duplicates by MinHash against brute force."""

import itertools
import random
from math import comb

import numpy as np
import pytest
from cases import documents, no_documents, sorted_rows
from check import TESTDATA
from test_rows import changed_copies, near_copies, shingles, smallest_linked

from fieldtally.llm import minhash
from fieldtally.llm.common import table
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.shingles import SKETCH, Points, pairs_with, shared

NAMES = ("doc_id", "n_shingles", "component_id")


def test_query(spark):
    folder = str(TESTDATA / "sf0.001")
    found = QUERIES["op12_minhash_dedup"](spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(smallest_linked(rows, 2, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("small", [1, 16])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(160) + changed_copies(160, 60, 0.3))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted_rows(found, *NAMES) == sorted(smallest_linked(rows, 2, 80), key=repr)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = minhash.near_duplicates(docs, 2, 80)
    assert found.columns == [*NAMES, "kept"]
    expected = [(i, len(shingles(t, 2)), c if shingles(t, 2) else i) for (i, t), (_, _, c) in zip(rows, smallest_linked(rows, 2, 80))]
    assert sorted_rows(found, *NAMES) == sorted(expected, key=repr)
    assert minhash.near_duplicates(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, 2, 50)


def test_signatures_estimate_similarity():
    draw = random.Random(1)
    for share in (0.2, 0.5, 0.8):
        both = [draw.getrandbits(63) for _ in range(int(6000 * share))]
        a, b = (np.unique(np.array(both + [draw.getrandbits(63) for _ in range((6000 - len(both)) // 2)])) for _ in range(2))
        true = len(both) / len(set(a) | set(b))
        assert (minhash.signature(a) == minhash.signature(b)).mean() == pytest.approx(true, abs=0.15)
        assert (minhash.signature(a) == minhash.signature(a[::-1])).all()


def test_pruned_by_the_posterior():
    """The tail of the beta posterior, integrated, is below the chosen probability just below each limit and not at it."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip(itertools.count(minhash.BATCH, minhash.BATCH), minhash.least_agreements(80)):
        for agreed, pruned in ((m - 1, True), (m, False)):
            density = (n + 1) * comb(n, agreed) * grid**agreed * (1 - grid) ** (n - agreed)
            assert (density[grid >= 0.8].mean() * 0.2 < minhash.MISS) == pruned


def test_bands_of_equal_signatures_only():
    draw = np.random.default_rng(2)
    signatures = draw.integers(0, 1 << 32, (3, minhash.BANDS * minhash.ROWS), dtype=np.uint32)
    signatures[1, : minhash.ROWS] = signatures[0, : minhash.ROWS]
    found = minhash.bands(signatures)
    assert found[0, 0] == found[1, 0] and len(np.unique(found)) == found.size - 1


def test_centres_meet_only_what_they_may_be_linked_with(spark):
    """A bucket of one large class and some others doesn't become a pair for every centre and point."""
    sketch = [3] * SKETCH
    point = lambda i, size, root, apart: (1, b"%04d" % i, size, 1, root, 340, 40, apart, sketch)
    rows = [point(i, 100, b"0000", False) for i in range(300)]
    rows += [point(300 + i, 100 if i < 4 else 300, b"%04d" % (300 + i), True) for i in range(40)]
    kind = "region long, key binary, size long, pos int, root binary, points long, outside long, apart boolean, sketch array<smallint>"
    regions = spark.createDataFrame(rows, kind)
    assert minhash.centres(regions, 0).count() == 1
    chosen = minhash.centres(regions, 1)
    assert chosen.where("apart").count() == 40
    pairs = {(bytes(a), bytes(b)) for a, b in pairs_with(regions, chosen, 80).collect()}
    assert pairs == {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[4] != b[4] and a[2] == b[2]}


def test_buckets_are_shuffled_once(spark):
    """Whatever its size, a table of buckets is dealt once by region; nothing is broadcast, and copies go."""
    rows = [(i % 50, b"%d" % (i % 120)) for i in range(600)] + [(1000 + i, b"alone") for i in range(9)] * 2
    found = shared(spark.createDataFrame(rows, "region long, key binary"))
    expected = {(r, k) for r, k in rows if len({k2 for r2, k2 in rows if r2 == r}) > 1}
    assert sorted((r.region, bytes(r.key)) for r in found.collect()) == sorted(expected)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ReusedExchange") == 1  # one of the two


def test_active_regions_are_dealt_once(spark):
    """Both sums over a region and the join with them need one shuffle, and known classes none."""
    rows = sorted({(i % 20, b"%03d" % (i % 90), 100, 1) for i in range(180)})
    frames = []
    points = Points.__new__(Points)
    points.scratch = lambda df: frames.append(df) or df
    points.classes = spark.createDataFrame([(b"%03d" % i, b"000") for i in range(0, 90, 10)], "key binary, root binary")
    found = points.active(spark.createDataFrame(rows, "region long, key binary, size long, pos int").localCheckpoint())
    held = {r: {k for r2, k, _, _ in rows if r2 == r} for r, _, _, _ in rows}
    mixed = {r: ks for r, ks in held.items() if not all(int(k) % 10 == 0 for k in ks)}
    assert sorted((r.region, bytes(r.key)) for r in found.collect()) == sorted((r, k) for r, ks in mixed.items() for k in ks)
    plan = frames[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(region") - plan.count("ReusedExchange") <= 1
    assert "Exchange hashpartitioning(key" not in plan
