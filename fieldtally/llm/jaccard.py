"""Exact Jaccard join of texts as sets of word shingles, as a join in a metric space.

One minus the Jaccard similarity is a metric. Several pivots of a region make Voronoi cells: each
point belongs to the pivot it is nearest to. What lies within the radius of a pivot is linked with
it, and so of one class with all else there. By the triangle inequality two linked points differ
by no more than the radius in their distance from any pivot, so a cell needs, beside its own
points, only those of a window beyond its boundary: points not further from its pivot than from
their own by more than twice the radius, and not further than ``NEAR`` and the radius. Points
further than ``NEAR`` from all pivots make a cell of their own. Cells with points of more than one
class are joined again in the same way: by cells of a few points pair by pair, else by new pivots.

Pivots can't divide all texts at once: unrelated texts are all at a distance of nearly one from
each other, so all would lie beyond each window. The first regions are therefore the texts that
share one of their rarest shingles, enough of them that two linked texts always share one. A
shingle is as rare as its rarest word, by a table of counts of the words of all texts, folded by
hash to a fixed size; any order is exact. For the same reason points of large cells are dealt anew
to regions by the shingles that are rarest among these points, and those get new pivots: every
turn compares pivots with all points of their region and leaves them out of the next, so the join
ends without a limit of depth.

Equal sets are one point. Links only matter here for the classes they make, so a region with
points of one class is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import packed, texts, written
from fieldtally.llm.shingles import Points, Scratch, active, at_hand, by_class, drawn_outside, keyed, marked, marks, not_alone, pairs_with, pairs_within, runs_of, shared, shingled, sketch, word_hashes

#: Bits of a word's hash that name its place in the table of counts.
COUNTED_BITS = 20
#: Bits of a shingle's hash that are counted, of them those that name its slice, and those of its place among the shared ones.
PREFIX_BITS, SLICE_BITS, SHARED_BITS = 40, 10, 26
#: Shingles a task holds before it gives them on.
HELD = 500_000
#: Points of a region that is compared pair by pair, and pivots of a larger one, times ``GROWTH`` each turn.
SMALL, PIVOTS, GROWTH = 16, 4, 4
#: About how many pivots of a region have cells; the others are compared alone.
CELLS = 4
#: Distance from a pivot up to which points are of its cell.
NEAR = 0.5
POINT = ("region", "key", "size", "pos")


def rarest(text: str | None, n: int, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text, and those of the rarest words: one more than two linked sets can differ in."""
    hashed = word_hashes(text)
    own, first = np.unique(runs_of(hashed, n), return_index=True)
    if not len(own):
        return own, own
    by_word, size = counts[places(hashed)], min(n, len(hashed))
    least = by_word[: len(hashed) - size + 1]
    for i in range(1, size):
        least = np.minimum(least, by_word[i : len(hashed) - size + 1 + i])
    kept = len(own) - -(-len(own) * percent // 100) + 1
    return own, own[np.lexsort((own, least[first]))[:kept]]


def sets_and_counts(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, text_key, key, size, sketch`` by row, and how often words of each place of the table stand in all texts.

    ``key`` stands for the set, and is null for an empty one. Both come from one pass; a task gives
    its table when it has read all its rows, and the sum of the tables has their fixed size.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.binary()), ("key", pa.binary()),
        ("size", pa.int64()), ("sketch", pa.list_(pa.int16())), ("place", pa.int32()), ("n", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTED_BITS, np.int64)
        for batch in batches:
            keys, sizes, sketches, found = [], [], [], [np.zeros(0, np.int64)]
            for text in texts(batch):
                hashed = word_hashes(text)
                own = np.unique(runs_of(hashed, n))
                found.append(places(hashed))
                keys.append(keyed(own) if len(own) else None)
                sizes.append(len(own))
                sketches.append(sketch(own))
            table += np.bincount(np.concatenate(found), minlength=len(table))
            nothing = [pa.nulls(len(keys), t) for t in schema.types[5:]]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())]
            columns.append(pa.array(sketches, schema.types[4]))
            yield pa.RecordBatch.from_arrays([*columns, *nothing], schema=schema)
        (used,) = np.nonzero(table)
        nothing = [pa.nulls(len(used), t) for t in schema.types[:5]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(used, pa.int32()), pa.array(table[used])], schema=schema)

    kind = "doc_id long, text_key binary, key binary, size long, sketch array<smallint>, place int, n long"
    found = written(shingled(docs).mapInArrow(run, kind))
    counts = found.where(F.col("place").isNotNull()).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNTED_BITS, np.int64)
    table[counts["place"].to_numpy()] = counts["n"].to_numpy()
    table = np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)
    return found.where(F.col("place").isNull()).select("doc_id", "text_key", "key", "size", "sketch"), table


def places(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


def slices(held: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The prefixes of hashes by slice, in order, as differences whose bytes stand by their place, so that they compress."""
    low = PREFIX_BITS - SLICE_BITS
    found = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]) >> np.uint64(64 - PREFIX_BITS))
    ends = np.searchsorted(found, np.arange((1 << SLICE_BITS) + 1, dtype=np.uint64) << np.uint64(low))
    for i in np.flatnonzero(np.diff(ends)):
        own = (found[ends[i] : ends[i + 1]] & np.uint64((1 << low) - 1)).astype("<u4")
        yield int(i), np.diff(own, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unsliced(held: bytes) -> np.ndarray:
    apart = np.frombuffer(held, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(apart).view("<u4")[:, 0], dtype=np.uint64)


def shared_shingles(rows: DataFrame, n: int, common, percent: int, scratch: Scratch) -> np.ndarray:
    """A table of bits of fixed size, set at the places of all rarest shingles that more than one set has, and of a few others.

    Only prefixes of hashes are shuffled, of some 3 bytes each, where rows of a region have ten times as many.
    A task gives a set once; copies that several tasks read make their shingles look shared, which leaves none out.
    """
    schema = pa.schema([("slice", pa.int32()), ("held", pa.binary())])
    low, narrow = PREFIX_BITS - SLICE_BITS, PREFIX_BITS - SHARED_BITS

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = common.value, set(), [], 0
        for batch in batches:
            for text in texts(batch):
                own, rare = rarest(text, n, counts, percent)
                key = keyed(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    held.append(rare.view(np.uint64))
                    size += len(rare)
            if size > HELD:
                yield batch_of(list(slices(held)))
                held, size = [], 0
        yield batch_of(list(slices(held)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slice: dict[int, list[bytes]] = {}
        for batch in batches:
            for i, held in zip(batch.column("slice").to_pylist(), batch.column("held").to_pylist()):
                by_slice.setdefault(i, []).append(held)
        for i in list(by_slice):
            own = np.sort(np.concatenate([unsliced(x) for x in by_slice.pop(i)]))
            bits = np.zeros(1 << (low - narrow), np.uint8)
            bits[own[1:][own[1:] == own[:-1]] >> np.uint64(narrow)] = 1
            yield batch_of([(i, np.packbits(bits, bitorder="little").tobytes())])

    kind = "slice int, held binary"
    dealt = rows.mapInArrow(give, kind).repartition("slice")
    found = scratch(dealt.mapInArrow(meet, kind)).toArrow()
    table = np.zeros((1 << SLICE_BITS, 1 << (low - narrow - 3)), np.uint8)
    for i, bits in zip(found["slice"].to_pylist(), found["held"].to_pylist()):
        table[i] = np.frombuffer(bits, np.uint8)
    return table.reshape(-1)


def first_regions(docs: DataFrame, wanted: DataFrame, n: int, table: np.ndarray, percent: int, scratch: Scratch) -> DataFrame:
    """``region, key, size, pos``: sets by each of their rarest shingles, where another set has it too and may be linked.

    Of each set there is one shingle more than two linked sets can differ in; those that no other
    set has, most of them, are told by a pass before and make no rows. ``wanted`` marks a row of each
    set, and a task gives a set once however many copies it reads, so copies don't gather at a shingle.
    """
    context = docs.sparkSession.sparkContext
    common = context.broadcast(table)
    chosen = marked(shingled(docs), wanted, "doc_id", "text_key").where("maybe").drop("maybe")
    met = context.broadcast(shared_shingles(chosen, n, common, percent, scratch))
    scratch.sweep()
    schema = pa.schema([("region", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits, seen = common.value, met.value, set()
        for batch in batches:
            found, pos, keys, sizes = [], [], [], []
            for text in texts(batch):
                own, rare = rarest(text, n, counts, percent)
                key = keyed(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                place = rare.view(np.uint64) >> np.uint64(64 - SHARED_BITS)
                (kept,) = np.nonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                found.append(rare[kept])
                pos.append(kept + 1)
                keys.append(key)
                sizes.append(len(own))
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            rare = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
            place = np.concatenate([*pos, np.zeros(0, np.int64)]).astype(np.int32)
            by_row = [pa.array(keys, pa.binary()).take(pa.array(row)), pa.array(np.array(sizes, np.int64)[row])]
            yield pa.RecordBatch.from_arrays([rare, *by_row, pa.array(place)], schema=schema)

    rows = chosen.mapInArrow(run, "region long, key binary, size long, pos int")
    found = shared(rows, F.min("size").alias("least"))
    return scratch(found.where(not_alone(percent)).drop("least"))


def pivots(regions: DataFrame, turn: int) -> DataFrame:
    """The rows of the pivots of larger regions, and whether they have cells, ``celled``.

    Of each the point with the rarest place of its shingle, and some points outside the largest
    class, drawn by hash; all of them if they are a few, and the region is done then.
    """
    celled = F.col("central") | drawn_outside(turn, CELLS)
    return regions.where(F.col("central") | drawn_outside(turn, PIVOTS * GROWTH**turn)).withColumn("celled", celled)


def cells(met: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``region, key`` of the Voronoi cells that points belong to or have in their window.

    ``met`` has ``region, key, pivot`` of the points that are left in a region and its pivots with cells, ``a, b``
    the same two in order, and ``found`` the compared pairs.
    """
    radius, rounding = 1 - percent / 100, 1e-9
    apart = met.join(found, ["a", "b"])
    apart = apart.select("region", "key", F.struct((1 - F.col("common") / F.col("total")).alias("d"), "pivot").alias("to"))
    # a few, as there are pivots with cells
    by_point = apart.groupBy("region", "key").agg(F.sort_array(F.collect_list("to")).alias("to"))
    least = F.col("to")[0]["d"]
    reach = F.least(least + 2 * radius, F.lit(NEAR + radius)) + rounding
    near = F.transform(F.filter("to", lambda x: x["d"] <= reach), lambda x: x["pivot"])
    far = F.when(least > NEAR, F.array(F.lit(b""))).otherwise(F.array().cast("array<binary>"))
    of_point = by_point.select("region", "key", F.explode(F.concat(near, far)).alias("cell"))
    return of_point.select("region", "key", F.xxhash64("region", "cell").alias("inner"))


def link(docs: DataFrame, n: int, sets: DataFrame, table: np.ndarray, percent: int, scratch: Scratch) -> DataFrame:
    """``key, root`` of the points linked with others, by ``percent`` of similarity or more."""
    # of copies one row is read, and a few others
    row = F.min(F.struct("doc_id", "text_key")).alias("row")
    rows = scratch(marks(sets.where(F.col("key").isNotNull()).groupBy("key").agg(row).select("row.*"), "doc_id", "text_key"))
    regions = first_regions(docs, rows, n, table, percent, scratch)
    known = sets.where(F.col("key").isNotNull()).join(regions.select("key").distinct(), "key", "left_semi")
    known = scratch(known.dropDuplicates(["key"]))
    sketches = known.select("key", "sketch")
    # at first every point is a class of its own, and none outside the largest
    regions = active(regions, None, scratch, once=True).withColumn("apart", F.lit(False))
    points, turn = None, 0
    while not regions.isEmpty():
        small, large = regions.where(F.col("points") <= SMALL), regions.where(F.col("points") > SMALL)
        # the first regions are many, and carry no sketches
        large = scratch(large.join(sketches, "key")) if turn else large
        drawn = scratch(pivots(large, turn))
        columns = [*POINT, "root", *["sketch"][: bool(turn)]]
        pairs = pairs_within(small, sketches, percent).unionByName(pairs_with(large.select(columns), drawn.select(columns), percent))
        pairs = scratch(pairs.distinct())
        if points is None:
            keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
            rows = known.select("key", "doc_id", "text_key").join(keys, "key", "left_semi")
            points = Points(docs, n, rows, percent, scratch)
            scratch.sweep()
        points.merge(points.compared(pairs))
        left = large.select(*POINT).join(at_hand(drawn.select("region", "key")), ["region", "key"], "left_anti")
        left = points.active(left)
        if left.isEmpty():
            break
        scratch.sweep()
        celled = at_hand(drawn.where("celled").select("region", F.col("key").alias("pivot")))
        met = left.select("region", "key").join(celled, "region")
        met = scratch(met.withColumns({"a": F.least("key", "pivot"), "b": F.greatest("key", "pivot")}))
        inner = cells(met, points.compared(scratch(met.select("a", "b").distinct())), percent)
        left = left.select(*POINT).join(inner, ["region", "key"]).drop("region").withColumnRenamed("inner", "region")
        left = points.active(left)
        # places in another order than those of the regions dealt anew are not to be compared with them
        few = left.where(F.col("points") <= SMALL).select(*POINT).withColumn("pos", F.lit(1))
        many = left.where(F.col("points") > SMALL).select("key", "size").dropDuplicates(["key"])
        turn += 1
        scratch.sweep()
        regions = points.active(few.unionByName(points.rare_regions(many, turn)), once=True)
        scratch.clear(regions, known, points.sets, points.classes)
    return written(points.classes) if points else sets.sparkSession.createDataFrame([], "key binary, root binary")


def classified(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, text_key, key, size, root`` by row; ``root`` stands for the class, and is null without words."""
    if not 0 < percent <= 100:
        raise ValueError("the similarity is a percentage above 0")
    scratch = Scratch(docs.sparkSession)
    try:
        sets, table = sets_and_counts(docs, n)
        roots = link(docs, n, sets, table, percent, scratch)
    finally:
        scratch.drop()
    return sets.drop("sketch").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every whole text, linked at ``percent`` or more.

    ``docs`` is read four times, so it should be a table; shingles aren't kept, since they are
    larger than the texts.

    A text's set is of the different runs of ``n`` words, or of the one run of all if there are
    fewer; ``component_id`` is the smallest ``doc_id`` that links lead to, itself included. A null
    or empty text has no shingles and is linked with nothing, not even its like, and keeps its own
    id. Very long texts are taken whole, like others. Missing ids are passed over in the smallest
    one. Repeated rows are linked like other copies and give a row each; an empty table gives an
    empty one; other columns are not looked at. Sets are compared by 64-bit hashes of shingles,
    and taken as equal by 128-bit hashes.
    """
    return by_class(classified(docs, n, percent))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which no other of the same class stays: of each class one, all columns as they were.

    The row of smallest ``doc_id`` stays (missing ids last), then of smallest text hash; of rows
    repeated whole, one. Rows without words are in no class and all stay. Classes as in
    :func:`components`.
    """
    rows = written(classified(docs, n, percent).drop("size"))
    known = rows.where(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    by_set = known.groupBy("root", "key").agg(F.min(order).alias("first"))
    chosen = by_set.groupBy("root").agg(F.min("first").alias("first"))
    chosen = written(chosen.select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("own")))

    def same(of: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [of[c].eqNullSafe(chosen[c]) for c in ("id", "own")])

    # texts are only shuffled where a row like theirs goes, and of a few others
    times = known.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("own")).agg(F.count("*").alias("n"))
    gone = times.where(F.col("n") > 1).drop("n").unionByName(times.drop("n").join(chosen, same(times), "left_anti"))
    text = F.col("row.text").cast("string")
    given = docs.select(packed(docs)).withColumns({"id": F.col("row.doc_id").cast("long"), "own": F.unhex(F.md5(text))})
    worded = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    given = marked(given.withColumn("worded", worded), written(marks(gone, "id", "own")), "id", "own")
    doubted = given.where(F.col("worded") & F.col("maybe"))
    kept = doubted.join(chosen, same(doubted), "left_semi").dropDuplicates(["id", "own"])
    kept = kept.select("row").unionByName(given.where(~(F.col("worded") & F.col("maybe"))).select("row"))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
