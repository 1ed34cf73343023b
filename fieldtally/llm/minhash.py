"""Near duplicates by banded MinHash signatures and sequential Bayesian verification.

A set's signature is the least of its shingles' hashes under each of ``BANDS * ROWS`` functions.
Sets with equal rows in a band are candidates: a set of similarity 0.8 misses all bands with a
probability of about 5e-8. The signatures of candidates are compared a batch after another. After
each, the posterior of the similarity, from a uniform prior and the hashes that agreed, gives the
probability that it reaches the threshold; below ``MISS`` the pair is pruned. Survivors are
verified by their whole sets.

No bucket is compared all with all but one of a few sets. In a larger one all are compared with
its centre; the links found make classes, and a bucket of one class is done. The
sets of what is left (a common passage may bring thousands of unlike texts into a bucket) are dealt
anew by those of their shingles that are rarest among them, which keeps every pair that can be
linked together, and compared with several centres of these smaller buckets, until none is left.
A set meets only centres of other classes that its size, the place of the bucket's shingle and
sketches of both don't rule out, so few of the rows of a bucket with one large class are made pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import texts, written
from fieldtally.llm.shingles import Points, Scratch, at_hand, by_class, drawn_outside, is_few, keyed, pairs_with, pairs_within, shared, shingled, shingles, sketch, with_central

BANDS, ROWS = 32, 4
#: Hashes compared between two looks at the posterior, and the probability at which a pair is pruned.
BATCH, MISS = 32, 1e-6
#: Sets of a bucket that are compared all with all, and centres of a larger one from the second turn on, times ``GROWTH`` each turn.
SMALL, CENTRES, GROWTH = 16, 64, 4
#: Shingles hashed at once.
AT_ONCE = 2048
POINT = ("region", "key", "size", "pos")


@lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the hash functions."""
    draw = np.random.default_rng(20)
    factors, addends = draw.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return factors | np.uint64(1), addends


def signature(own: np.ndarray) -> np.ndarray:
    """The least hash of the shingles by function, upper 32 bits of a product and sum modulo 2^64."""
    factors, addends = functions()
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    values = own.view(np.uint64)
    for i in range(0, len(values), AT_ONCE):
        hashed = values[i : i + AT_ONCE, None] * factors + addends
        least = np.minimum(least, (hashed >> np.uint64(32)).min(0).astype(np.uint32))
    return least


def bands(signatures: np.ndarray) -> np.ndarray:
    """By signature and band a hash of the band's rows and its number."""
    found = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for row in range(ROWS):
        found = (found ^ signatures[:, row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found.view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """By row a signature."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, key, size, sketch, signature`` by row; written.

    ``key`` stands for the set, and is null for an empty one. A task gives the signature of a set
    once, and null for further copies it reads.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.binary()), ("key", pa.binary()),
        ("size", pa.int64()), ("sketch", pa.list_(pa.int16())), ("signature", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, sizes, sketches, found = [], [], [], []
            for text in texts(batch):
                own = shingles(text, n)
                key = keyed(own) if len(own) else None
                new = key is not None and key not in seen
                seen.add(key)
                keys.append(key)
                sizes.append(len(own))
                sketches.append(sketch(own) if new else None)
                found.append(signature(own).tobytes() if new else None)
            columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, schema.types[4]), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], schema=schema)

    kind = "doc_id long, text_key binary, key binary, size long, sketch array<smallint>, signature binary"
    return written(shingled(docs).mapInArrow(run, kind))


def buckets(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``region, key`` of sets by each band in which another set agrees, and of these the rows, one each; written."""
    schema = pa.schema([("region", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bands(matrix(batch.column("signature"))).ravel()
            by_row = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("key").take(pa.array(by_row))], schema=schema)

    one = rows.where(F.col("signature").isNotNull())
    several = scratch(shared(one.select("key", "signature").mapInArrow(run, "region long, key binary")))
    scratch.sweep()
    keys = several.select("key")
    keys = F.broadcast(keys) if is_few(several) else at_hand(scratch(keys.distinct()))
    return several, scratch(one.join(keys, "key", "left_semi").dropDuplicates(["key"]))


def least_agreements(percent: int) -> list[int]:
    """By batch the fewest agreeing hashes of all so far that a pair needs not to be pruned.

    With a uniform prior the similarity's posterior after ``m`` of ``n`` hashes agreed is a beta
    distribution, whose upper tail is a sum of binomial probabilities.
    """
    t, needed = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:  # probability of the threshold or more, given that m hashes agreed
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        needed.append(m)
    return needed


def plausible(pairs: DataFrame, signatures: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b`` of written pairs that batches of their signatures don't rule out; written."""
    needed = least_agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = matrix(batch.column("of_a")), matrix(batch.column("of_b"))
            rest, agreed = np.arange(batch.num_rows), np.zeros(batch.num_rows, int)
            for i, least in enumerate(needed):
                part = slice(i * BATCH, (i + 1) * BATCH)
                agreed[rest] += (left[rest, part] == right[rest, part]).sum(1)
                rest = rest[agreed[rest] >= least]
            yield batch.select(["a", "b"]).take(pa.array(rest))

    pairs = at_hand(pairs)
    of_b = signatures.toDF("b", "of_b").join(pairs, "b")
    both = of_b.join(signatures.toDF("a", "of_a"), "a").select("a", "b", "of_a", "of_b")
    return scratch(both.mapInArrow(run, "a binary, b binary"))


def centres(regions: DataFrame, turn: int) -> DataFrame:
    """The rows of the centres: of each region the set with the rarest place of its shingle and, after the first turn, some outside the largest class, drawn by hash.

    At first every set is a class of its own, and one centre of each bucket finds most of the copies.
    """
    chosen = F.col("central")
    if turn:
        chosen |= drawn_outside(turn, CENTRES * GROWTH ** (turn - 1))
    return with_central(regions).where(chosen)


def link(docs: DataFrame, n: int, rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``key, root`` of the sets linked with others, by ``percent`` of similarity or more; written."""
    regions, known = buckets(rows, scratch)
    signatures = known.select("key", "signature")
    points, turn = Points(docs, n, known.select("key", "doc_id", "text_key"), percent, scratch), 0
    sketches = known.select("key", "sketch")
    regions = regions.join(at_hand(known.select("key", "size")), "key").select("region", "key", "size", F.lit(1).alias("pos"))
    regions = points.active(regions)
    while not regions.isEmpty():
        small, large = regions.where(F.col("points") <= SMALL), regions.where(F.col("points") > SMALL)
        # the first buckets are many, and carry no sketches
        large = scratch(large.join(sketches, "key")) if turn else large
        drawn = scratch(centres(large, turn))
        columns = [*POINT, "root", *["sketch"][: bool(turn)]]
        pairs = pairs_within(small, sketches, percent).unionByName(pairs_with(large.select(columns), drawn.select(columns), percent))
        pairs = scratch(pairs.distinct())
        points.merge(points.compared(plausible(pairs, signatures, percent, scratch)))
        left = large.select(*POINT).join(at_hand(drawn.select("region", "key")), ["region", "key"], "left_anti")
        many = points.active(left).select("key", "size").dropDuplicates(["key"])
        turn += 1
        scratch.sweep()
        regions = points.active(points.rare_regions(many, turn))
    return written(points.classes)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every whole text, linked at ``percent`` or more.

    A text's set is of the different runs of ``n`` words, or of the one run of all if there are
    fewer; ``component_id`` is the smallest ``doc_id`` that links lead to, itself included, and
    ``kept`` tells whether it is the row's own. A null or empty text has no shingles, is linked with
    nothing, not even its like, and keeps its own id. Very long texts are taken whole, some
    shingles at a time. Missing ids are passed over in the smallest one; a class of them alone has
    none. Repeated rows are linked like other copies and give a row each; equal sets are one point,
    whatever their number. An empty table gives an empty one; other columns are not looked at.

    Every link found is confirmed on whole sets of 64-bit hashes; one of similarity 0.8 is missed
    with a probability of about 4e-6, a closer one less. The bands suit similarities from 0.8 on;
    below that they miss more, and ``percent`` below 70 is an error.
    """
    if not 70 <= percent <= 100:
        raise ValueError("the bands suit similarities from 70 to 100 percent")
    scratch = Scratch(docs.sparkSession)
    try:
        rows = signed(docs, n)
        roots = link(docs, n, rows, percent, scratch)
    finally:
        scratch.drop()
    rows = rows.select("doc_id", "key", "size").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = by_class(rows)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
