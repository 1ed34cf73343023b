"""Exact top-k by inner product, by aggregating sorted lists without random access.

A block of vectors is held as one sorted list for each component. A query reads the list of a
component from its large end where its own component is positive, from its small end where that
is negative, all lists to the same depth. What has been read of a vector counts as it is; what
hasn't is bounded by the last value read on one side and by the end of the list on the other.
That gives each vector a lower and an upper bound. Lists are read on until few vectors have an
upper bound that reaches the k-th lower bound; only for those are scores resolved.

The bounds of all vectors for many queries are products of two matrices: with the values not yet
read replaced by their bounds, a block times the positive and the negative parts of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a broadcast, at most; queries taken through a block at once.
BLOCK, QUERIES, AT_ONCE = 1 << 16, 1 << 14, 128
#: Depths of the lists at which bounds are compared, as shares of their length.
DEPTHS = (0.8, 0.88, 0.95)
#: Share of a block, and times k, that may be left when scores are resolved.
FEW = 0.03
#: Sums of products below these are exact in 32-bit and 64-bit floats; scores must stay below the last.
EXACT_32, EXACT_64, MOST = 1 << 24, 1 << 53, 1 << 62


class SortedLists:
    """Vectors as sorted lists of their components."""

    def __init__(self, vectors: np.ndarray, kind: type, slack: float):
        """``vectors`` are whole numbers; bounds are taken in floats of ``kind``, ``slack`` off at most."""
        self.whole, self.kind, self.slack = vectors, kind, slack
        self.vectors = vectors.astype(kind)
        self.ascending = np.sort(self.vectors, axis=0)

    def bounds(self, queries: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, by query and vector, when ``depth`` of each list is read."""
        n, x = len(self.vectors), self.vectors
        read = min(n, max(1, int(np.ceil(n * depth))))
        least, most = self.ascending[0], self.ascending[-1]
        last_from_top, last_from_bottom = self.ascending[n - read], self.ascending[read - 1]
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        lower = positive @ np.where(x >= last_from_top, x, least).T + negative @ np.where(x <= last_from_bottom, x, most).T
        upper = positive @ np.maximum(x, last_from_top).T + negative @ np.minimum(x, last_from_bottom).T
        return lower - self.kind(self.slack), upper + self.kind(self.slack)

    def search(self, queries: np.ndarray, k: int, known: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of a query, places of the vectors that can be among its k best, and their scores.

        ``known`` is a score by query that k vectors elsewhere reach already, and ``own`` says by
        query and vector which are the query's own.
        """
        whole, queries = queries, queries.astype(self.kind)
        n = len(self.vectors)
        left, limit = np.arange(len(queries)), max(4 * k, int(FEW * n))
        for depth in (*DEPTHS, 1.0):
            lower, upper = self.bounds(queries[left], depth)
            lower[own[left]], upper[own[left]] = -np.inf, -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(left), -np.inf, self.kind)
            can = (upper >= np.maximum(kth, known[left] - self.kind(self.slack))[:, None]) & np.isfinite(upper)
            done = (can.sum(1) <= limit) | (depth == 1.0)
            for i in np.flatnonzero(done).tolist():
                places = np.flatnonzero(can[i])
                yield int(left[i]), places, self.whole[places] @ whole[left[i]]
            left = left[~done]
            if not left.size:
                return


def whole_numbers(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; null if the vector or a component is missing or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def precision(width: int, largest: int, largest_asked: int) -> tuple[type, float]:
    """The floats that bounds are taken in, and how far off they can be, from the largest components of both sides."""
    most = width * largest * largest_asked
    if most >= MOST:
        raise ValueError(f"components up to {largest} and {largest_asked} can give scores beyond 64 bits; take a smaller scale")
    if max(most, largest, largest_asked) < EXACT_32:
        return np.float32, 0.0
    if max(most, largest, largest_asked) < EXACT_64:
        return np.float64, 0.0
    return np.float64, most * (2 * width + 8) / EXACT_64  # twice the rounding of all components, products and sums


def largest_of(numbers: np.ndarray) -> int:
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` vectors of largest inner product.

    Both frames have ``vec_id`` and ``embedding``. Components are multiplied by ``scale`` and
    rounded down first, so scores are whole numbers; ties go to the smaller ``vec_id``. Rows of a
    query's own id are not among its results. A vector that is null, or has a component that is null or
    not finite, takes no part, and neither does one without an id. Shorter vectors count as filled
    with zeros. A row repeated whole among the queries is asked once; among the vectors each is
    found. Without vectors or queries the result is empty. Very long vectors are handled like others. Scores are summed as 64-bit integers. Bounds are 32-bit floats where the largest components
    show that these are exact, else 64-bit ones, widened by their rounding where they aren't exact.
    Components so large that width times the largest of both sides reaches 2^62 are an error.

    Queries are broadcast ``QUERIES`` at a time. Each task reads vectors into blocks and keeps its
    best ``k`` a query; those meet in a window over the tasks' results.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, scale)
    asked = prepared(queries, scale).distinct()
    n = asked.count()
    out = None
    sizes = F.transform("numbers", lambda x: F.abs(x.cast("double")))  # as double: the least long has no opposite
    width, largest = (x or 0 for x in rows.agg(F.max(F.size("numbers")), F.max(F.array_max(sizes))).first())
    for part in range(-(-n // QUERIES)):
        parts = -(-n // QUERIES)
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id", "numbers").toArrow()
        if not some.num_rows:
            continue
        own_width = max(width, max(len(x) for x in some["numbers"].to_pylist()))
        asked_ids = some["vec_id"].to_numpy()
        numbers = matrix(some["numbers"].combine_chunks(), own_width)
        shared = spark.sparkContext.broadcast((asked_ids, numbers, *precision(own_width, int(largest), largest_of(numbers))))
        found = rows.mapInArrow(searcher(shared, k), "query int, query_id long, vec_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("numbers"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("numbers").isNotNull())


def searcher(shared, k: int):
    """A function over batches of vectors that gives the ``k`` best of each query among them."""
    schema = pa.schema([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, kind, slack = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)  # ids and scores by query
        for ids, block in collected(batches, queries.shape[1]):
            lists = SortedLists(block, kind, slack)
            for at in range(0, len(queries), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                known = np.array([s[-1] if len(s) == k else -np.inf for _, s in best[some]], kind)
                own = query_ids[some, None] == ids[None, :]
                for i, places, scores in lists.search(queries[some], k, known, own):
                    old_ids, old_scores = best[at + i]
                    all_ids = np.concatenate([old_ids, ids[places]])
                    all_scores = np.concatenate([old_scores, scores])
                    first = np.lexsort((all_ids, -all_scores))[:k]
                    best[at + i] = all_ids[first], all_scores[first]
        for at in range(0, len(queries), AT_ONCE):
            some = best[at : at + AT_ONCE]
            sizes = [len(x) for x, _ in some]
            number = np.repeat(np.arange(at, at + len(some)), sizes)
            columns = [number.astype(np.int32), query_ids[number], np.concatenate([x for x, _ in some]), np.concatenate([s for _, s in some])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def collected(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of up to ``BLOCK`` rows."""
    ids, blocks, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if size + part.num_rows > BLOCK and size:
                yield np.concatenate(ids), np.concatenate(blocks)
                ids, blocks, size = [], [], 0
            ids.append(part.column("vec_id").to_numpy())
            blocks.append(matrix(part.column("numbers"), width))
            size += part.num_rows
    if size:
        yield np.concatenate(ids), np.concatenate(blocks)
