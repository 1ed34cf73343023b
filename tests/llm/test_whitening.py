"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from check import TESTDATA
from fieldtally.llm import whitening
from fieldtally.llm.common import table
from fieldtally.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n long, component string, whitened string"


def whole(vector):
    return [math.floor(64 * float(c)) + 1_000_000 for c in vector]


def expected(rows, most=32):
    """By id and component: n, deviation, size of the whitened value, explained share."""
    x = [whole(v) for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array([[c / n for c in row] for row in apart])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-10 * values[0]).sum()))
    found = np.abs(centred @ axes[:, :k] / np.sqrt(values[:k]))
    shares = values / values.sum()
    return {
        (rows[i][0], j + 1): (n, sum(c * c for c in apart[i]), found[i, j], shares[j]) for i in range(n) for j in range(k)
    }


def agree(rows, given):
    wanted = expected(given)
    assert len(rows) == len(wanted)
    for r in rows:
        n, deviation, size, share = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-9)
        assert r.explained == pytest.approx(share, rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_query(spark):
    folder = str(TESTDATA / "sf0.001")
    rows = QUERIES["op13_embedding_whitening"](spark, folder).collect()
    given = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    agree(rows, given)
    by_component = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.component, r.vec_id))]).reshape(32, -1)
    assert np.abs(by_component @ by_component.T / by_component.shape[1] - np.eye(32)).max() < 1e-9


def matrices():
    draw = np.random.default_rng(3)
    spread = draw.normal(size=(300, 40)) * np.linspace(1, 30, 40)
    low_rank = draw.normal(size=(300, 6)) @ draw.normal(size=(6, 40))
    equal = np.vstack([np.eye(40), -np.eye(40)])
    pairs = np.repeat(draw.normal(size=(300, 16)), 2, axis=1)
    two = np.hstack([draw.normal(size=(300, 20)) * 1e4, draw.normal(size=(300, 20))])
    return {"spread": spread, "low rank": low_rank, "equal": equal, "pairs": pairs, "two scales": two, "one": spread[:, :1]}


@pytest.mark.parametrize("name", list(matrices()))
def test_eigenvectors(name):
    x = matrices()[name]
    x = x - x.mean(0)
    matrix = x.T @ x / len(x)
    values, axes = whitening.leading(matrix, 32)
    truth = np.linalg.eigvalsh(matrix)[::-1]
    rank = int((truth > 1e-12 * truth[0]).sum())
    assert len(values) == min(32, rank)
    assert np.abs(values - truth[: len(values)]).max() < 1e-13 * truth[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ axes - axes * values).max() < 1e-13 * truth[0]


def test_inertia_locates_all_eigenvalues():
    draw = np.random.default_rng(5)
    matrix = np.diag([0.5, 0.5, 0.5, 0.1, 0.1, 0.0, 0.9]) + 0.0
    turn, _ = np.linalg.qr(draw.normal(size=(7, 7)))
    found = whitening.located(*whitening.tridiagonal(turn @ matrix @ turn.T))
    assert np.abs(found - [0.9, 0.5, 0.5, 0.5, 0.1, 0.1, 0.0]).max() < 1e-14


def test_no_variance():
    assert whitening.leading(np.zeros((3, 3)), 32)[0].size == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "c", "w") for i, v in rows], SCHEMA)


def test_edges(spark):
    draw = np.random.default_rng(9)
    good = [(i, draw.normal(size=3).astype(np.float32).tolist()) for i in range(9)]
    good += [(20, good[0][1]), (None, [0.25, -1.0, 3.0])]
    bad = [(30, None), (31, []), (32, [1.0, None, 2.0]), (33, [1.0, float("nan"), 2.0]), (34, [1.0, 2.0, float("inf")]), (35, [1.0]), (36, [1.0] * 5)]
    agree(whitening.whiten(frame(spark, good + bad).repartition(4)).collect(), good)
    twice = whitening.whiten(frame(spark, good + good))
    assert twice.count() == 2 * 3 * len(good) and twice.first().n == 2 * len(good)
    for none in ([], bad[:5], good[:1], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        found = whitening.whiten(frame(spark, none))
        assert found.count() == 0 and found.columns == twice.columns


def test_large_components(spark):
    rows = [(i, [1e4 * i * i, -3e3 * i, 1e3 * (i % 3)]) for i in range(8)]
    agree(whitening.whiten(frame(spark, rows)).collect(), [(i, np.array(v, np.float32).tolist()) for i, v in rows])
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30]), (2, [1.0])])).collect()


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 28, 1 << 40])
def test_exact_products(size):
    numbers = np.random.default_rng(size).integers(-size, size, (50, 4))
    wide = numbers.astype(object)
    assert (whitening.exact_products(numbers) == wide.T @ wide).all()
    assert whitening.exact_sum(numbers) == wide.sum(0).tolist()
