"""Whitening of embeddings by principal components from a contour integral.

The covariance is exact: components are made whole numbers, their sums and products are added as
integers in tasks and by Spark, and it is rounded once. Its eigenvalues are found by FEAST. Counts
of inertia (how many eigenvalues of a shifted matrix are negative) tell where eigenvalues lie, and
the spectrum is cut in gaps into intervals of a few. For each interval, a quadrature over a circle around it of solves with the
covariance, shifted by complex points of the circle, projects random vectors onto the eigenvectors
of that interval; Rayleigh-Ritz extracts them, again until they stop improving. Their number must
be the inertia's count, or the subspace is made larger.

The driver holds matrices of as many rows as vectors have components, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is added to each whole number, and the numbers a component of 1 is made.
OFFSET, SCALE = 1_000_000, 64
#: Eigenvalues of an interval, points of the quadrature, and most turns of it.
FEW, POINTS, TURNS = 8, 8, 20
#: Largest integer up to which sums of doubles are exact, and the largest long.
EXACT, LONG = 1 << 53, (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    width: int  #: components of a vector
    n: int  #: vectors
    base: np.ndarray  #: whole numbers near the mean
    rest: np.ndarray  #: n times what the mean is above them, exact
    axes: np.ndarray  #: unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray  #: their eigenvalues
    trace: float


# vectors of whole numbers


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows with an embedding of finite components, at least one."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return given.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fit)


def usual_width(vectors: DataFrame) -> int:
    """How many components most vectors have, of as many the larger number; 0 without vectors."""
    counts = vectors.groupBy(F.size("vector").alias("width")).count()
    first = counts.orderBy(F.desc("count"), F.desc("width")).first()
    return first["width"] if first else 0


def whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """By row and component the whole number ``floor(64 * c) + 1000000``, for vectors of ``width``."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    numbers = np.floor(SCALE * flat)
    if numbers.size and np.abs(numbers).max() >= LONG - 2 * OFFSET:
        raise ValueError("a component is too large for a whole number of 64 bits")
    return numbers.astype(np.int64) + OFFSET


def exact_sum(numbers: np.ndarray) -> list[int]:
    """Sums by column as Python integers."""
    if not numbers.size or int(np.abs(numbers).max()) * len(numbers) <= LONG:
        return numbers.sum(0).tolist()
    return numbers.astype(object).sum(0).tolist()


def exact_products(numbers: np.ndarray) -> np.ndarray:
    """``numbers.T @ numbers`` as Python integers; in doubles, as many rows at once as are summed without rounding."""
    width = numbers.shape[1]
    found = np.zeros((width, width), object)
    most = int(np.abs(numbers).max()) if numbers.size else 0
    step = EXACT // max(most * most, 1)
    if not step:
        wide = numbers.astype(object)
        return wide.T @ wide
    for i in range(0, len(numbers), step):
        block = numbers[i : i + step].astype(np.float64)
        found += (block.T @ block).astype(np.int64)
    return found


def summed(rows: DataFrame, width: int, parts: Callable[[np.ndarray], dict[int, int]]) -> dict[int, int]:
    """Sums over all vectors of what ``parts`` gives for some, exact; a task gives its sums when it has read its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for at, value in parts(whole(batch, width)).items():
                total[at] = total.get(at, 0) + value
        columns = [pa.array(list(total), pa.int32()), pa.array([str(v) for v in total.values()], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["at", "value"])

    found = rows.select("vector").mapInArrow(run, "at int, value string")
    found = found.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {r["at"]: int(r["value"]) for r in found.collect()}


# eigenvectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and first off-diagonal of a similar matrix, by Householder reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size:
            x /= size
            a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each value: the negative pivots of the factors of the matrix less that value."""
    tiny = np.finfo(float).tiny ** 0.5
    negative, pivot = np.zeros(len(at), int), np.ones(len(at))
    for d, b in zip(diagonal, np.concatenate([[0.0], beside])):
        pivot = d - at - b * b / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        negative += pivot < 0
    return negative


def located(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Where the eigenvalues lie, falling: all bisected together by counts of inertia, from -1 to 2."""
    rank = np.arange(len(diagonal))
    low, high = np.full(len(rank), -1.0), np.full(len(rank), 2.0)
    for _ in range(56):
        middle = (low + high) / 2
        above = inertia(diagonal, beside, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return ((low + high) / 2)[::-1]


def intervals(values: np.ndarray, most: int, tolerance: float) -> Iterator[tuple[float, float]]:
    """Bounds of intervals that hold the first ``most`` of falling values, in gaps between them.

    An interval holds ``FEW`` values, or fewer where the gap below would be a small part of it, or
    more where no gap parts them.
    """
    first = 0
    while first < min(most, len(values)) and values[first] > tolerance:
        above = values[first - 1] - values[first] if first else values[first]
        found = []
        for end in range(first + 1, len(values) + 1):
            below = values[end - 1] - (values[end] if end < len(values) else 0)
            if below <= tolerance:
                continue
            span = values[first] - values[end - 1]
            top = values[first] + min(above, max(below, span)) / 2
            bottom = values[end - 1] - below / 2
            found.append((below / (top - bottom), end, bottom, top))
            if end - first >= FEW:
                break
        if not found:  # down to rounding
            yield values[-1] - tolerance, values[first] + above / 2
            return
        wide = [x for x in found if x[0] >= 0.2 and x[1] - first <= FEW]
        _, first, bottom, top = wide[-1] if wide else max(found)
        yield bottom, top


def contour(matrix: np.ndarray, low: float, high: float, found: int, floor: float) -> np.ndarray:
    """Orthonormal vectors that span the eigenvectors of the eigenvalues between ``low`` and ``high``, ``found`` of them."""
    width = len(matrix)
    centre, radius = (low + high) / 2, max((high - low) / 2, floor)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi * (1 + nodes) / 2
    draw = np.random.default_rng(11)
    size = min(width, found + max(4, found // 2))
    while True:
        probe, best, least = draw.normal(size=(width, size)), None, np.inf
        for _ in range(TURNS):
            projected = np.zeros_like(probe)
            for angle, weight in zip(angles, weights):  # the lower half of the circle is the conjugate of the upper
                turn = radius * np.exp(1j * angle)
                shifted = (centre + turn) * np.eye(width) - matrix
                projected += weight / 2 * (turn * np.linalg.solve(shifted, probe.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            probe = basis @ small
            inside = (values >= low) & (values < high)
            if inside.sum() != found:
                continue
            left = np.abs(matrix @ probe[:, inside] - probe[:, inside] * values[inside]).max()
            if left >= least / 2:  # it no longer improves
                break
            best, least = probe[:, inside], left
        if best is not None:
            return best
        if size == width:
            raise ArithmeticError("the eigenvectors found are not as many as the inertia counts")
        size = min(width, 2 * size)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those of rounding alone are left out."""
    width, scale = len(matrix), float(np.trace(matrix))
    if not scale > 0:
        return np.zeros(0), np.zeros((width, 0))
    matrix = matrix / scale  # all eigenvalues are from 0 to 1 now
    tolerance = 16 * width * np.finfo(float).eps
    diagonal, beside = tridiagonal(matrix)
    parts = []
    for low, high in intervals(located(diagonal, beside), most, tolerance):
        below, up_to = inertia(diagonal, beside, np.array([low, high]))
        parts.append(contour(matrix, low, high, int(up_to - below), tolerance))
    basis, _ = np.linalg.qr(np.hstack(parts))
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:most]
    return values[order] * scale, (basis @ small)[:, order]


# fitting and applying


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """The components of all usable vectors, ``most`` at most; ``None`` without usable vectors."""
    rows = usable(vectors)
    width = usual_width(rows)
    if not width:
        return None
    rows = rows.where(F.size("vector") == width)
    sums = summed(rows, width, lambda x: dict(enumerate([*exact_sum(x), len(x)])))
    n = sums[width]
    base = np.array([sums[i] // n for i in range(width)], np.int64)
    upper = np.triu_indices(width)

    def products(numbers: np.ndarray) -> dict[int, int]:
        return dict(enumerate(exact_products(numbers - base)[upper].tolist()))

    found = summed(rows, width, products)
    rest = [sums[i] - n * int(base[i]) for i in range(width)]  # n times the mean above the base
    matrix = np.zeros((width, width))
    for at, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        matrix[i, j] = matrix[j, i] = (n * found[at] - rest[i] * rest[j]) / (n * n)  # integers, rounded once
    values, axes = leading(matrix, most)
    return Whitening(width, n, base, np.array(rest), axes, values, float(np.trace(matrix)))


def centred(model: Whitening, numbers: np.ndarray) -> np.ndarray:
    """By row and component n times the distance from the mean, exact, where longs hold it, else as Python integers."""
    near = numbers - model.base
    most = (int(np.abs(near).max()) + 1) * model.n if near.size else 0
    return model.n * (near if most < LONG // 2 else near.astype(object)) - model.rest


def deviations(apart: np.ndarray) -> np.ndarray:
    """By row the sum of squares, exact."""
    most = int(np.abs(apart).max()) if apart.size else 0
    if most * most * apart.shape[1] > LONG:
        apart = apart.astype(object)
    found = (apart * apart).sum(1)
    if found.size and int(found.max()) > LONG:
        raise ValueError("a deviation is too large for a whole number of 64 bits")
    return found.astype(np.int64)


def whitened(model: Whitening, apart: np.ndarray) -> np.ndarray:
    """By row and component of the model, in units of its standard deviation."""
    return (apart.astype(np.float64) / model.n) @ (model.axes / np.sqrt(model.values))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest difference of the covariance of the whitened vectors from that of independent ones.

    From sums and products of all whitened vectors, which tasks add up for their rows.
    """
    k = len(model.values)
    rows = usable(vectors).where(F.size("vector") == model.width).select("vector")
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            found = whitened(held, centred(held, whole(batch, held.width)))
            sums += found.sum(0)
            products += found.T @ found
        values = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.array([r["value"] for r in sorted(found, key=lambda r: r["at"])]) / model.n
    mean, second = values[:k], values[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not looked at. Rows take no part
    whose embedding is null or empty or holds null or non-finite components, or has another number of
    components than most have (of numbers that are equally frequent, the larger one counts).
    Repeated rows count and are returned each. Vectors may be of any length; the driver holds
    square matrices of that many rows.

    There are ``most`` components, or as many as the covariance has rank: what is without variance
    can't be whitened. So equal vectors, a single one, or an empty table give an empty result. Of
    equal eigenvalues, any unit vectors that span the same are right. A component or deviation
    beyond whole numbers of 64 bits is an error.
    """
    spark, model = vectors.sparkSession, fit(vectors, most)
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    error = identity_error(vectors, model)
    shared = spark.sparkContext.broadcast(model)
    rows = usable(vectors).where(F.size("vector") == model.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        k = len(held.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                apart = centred(held, whole(some, held.width))
                rows = len(apart)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, held.n)),
                        pa.array(np.repeat(deviations(apart), k)),
                        pa.array(whitened(held, apart).ravel()),
                        pa.array(np.tile(held.values / held.trace, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT)
