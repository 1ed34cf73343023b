"""Texts as sets of word shingles, and what joins of such sets share.

A set is of 64-bit hashes of runs of words, and 128 bits of all its hashes stand for it. Sets that
may be linked lie in regions, tables of ``region, key, size, pos``: ``pos`` is the place of the
region's shingle among those of the set, the rarest first.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import texts, write_to
from fieldtally.session import shared_folder

#: Rows of at most 50 bytes that are broadcast; more are shuffled, and so are sets, whatever their number.
BROADCAST_ROWS = 200_000
#: Chosen points of regions, of some 200 bytes with their sketches, that are broadcast.
CHOSEN_ROWS = 50_000
#: Bits of a row's place in the table of marks, which is broadcast at every size: 2^18 rows at most.
MARKED_BITS = 24
#: Places of a sketch.
SKETCH = 32


class Scratch:
    """Tables written to the shared folder, also for after the loss of an executor; dropped together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number, self.made = spark, count(), []
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made.append(next(self.number))
        return write_to(df, f"{self.folder}/{self.made[-1]}")

    def clear(self, *kept: DataFrame) -> None:
        """Removes the tables made so far but those the given frames are read from, and what `sweep` does."""
        used = {f.rsplit("/", 2)[-2] for frame in kept for f in frame.inputFiles()}
        gone, self.made = [i for i in self.made if str(i) not in used], [i for i in self.made if str(i) in used]
        for i in gone:
            self._delete(f"{self.folder}/{i}")
        self.sweep()

    def sweep(self) -> None:
        """Has Spark remove the shuffle files of frames that are no longer used; it does when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        """Removes them all; nothing may read them any more."""
        self._delete(self.folder)
        self.sweep()

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word; A-Z are lower-cased, and words are what stands between ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs_of(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; with fewer words, of the one run of all."""
    size = min(n, len(hashed))
    if not size:
        return np.zeros(0, np.int64)
    runs = np.full(len(hashed) - size + 1, size, np.uint64)
    for i in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - size + 1 + i]
        runs ^= runs >> np.uint64(29)
    return runs.view(np.int64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``n`` words."""
    return np.unique(runs_of(word_hashes(text), n))


def keyed(values: np.ndarray) -> bytes:
    """What stands for a set: 128 bits of its sorted hashes."""
    return xxhash.xxh3_128_digest(values.tobytes())


def sketch(own: np.ndarray) -> list[int]:
    """How many shingles have each value of the lowest bits of their hash."""
    return np.minimum(np.bincount(own & (SKETCH - 1), minlength=SKETCH), 32767).tolist()


def shingled(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def at_hand(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has no more than ``most`` rows, else joined by shuffle."""
    return F.broadcast(rows) if is_few(rows, most) else rows


def is_few(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return rows.limit(most + 1).count() <= most


def marks(rows: DataFrame, *columns: str) -> DataFrame:
    """``word, bits``: a bit at the place of each row's hash, in a table of fixed size, to be written."""
    place = _place(*columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place["bit"])
    return rows.select(place["word"].alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def marked(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The rows with ``maybe``, whether their place is marked: those whose hash is, and a few others. No row is shuffled."""
    place = _place(*columns)
    found = rows.withColumn("place", F.struct(place["word"].alias("word"), place["bit"].alias("bit")))
    table = F.broadcast(table.toDF("word_marked", "bits_marked"))
    found = found.join(table, F.col("place.word") == F.col("word_marked"), "left")
    maybe = F.coalesce(F.getbit("bits_marked", F.col("place.bit")) == 1, F.lit(False))
    return found.select(*rows.columns, maybe.alias("maybe"))


def _place(*columns: str) -> dict[str, Column]:
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << MARKED_BITS))
    return {"word": F.shiftright(place, 6), "bit": place.bitwiseAND(F.lit(63)).cast("int")}


def shared(rows: DataFrame, *of_region: Column) -> DataFrame:
    """The rows of ``region, key, ...`` whose region another set has too, each set once in a region, with aggregates of the region.

    Regions are told apart by the least and greatest hash of their sets, so nothing gathers at one.
    Their number grows with the input, so they are joined by shuffle, at every size. Both sides use all
    columns and are dealt by region, so one shuffle serves them, and ``rows`` are made once.
    """
    mark = F.xxhash64(*[c for c in rows.columns if c != "region"])
    dealt = rows.repartition("region")
    several = dealt.groupBy("region").agg(F.min(mark).alias("x"), F.max(mark).alias("y"), *of_region)
    several = several.where(F.col("x") != F.col("y")).drop("x", "y")
    return dealt.join(several.hint("merge"), "region").dropDuplicates(["region", "key"])


def linked(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("total") * percent


def may_link(percent: int, sketched: bool = True) -> Column:
    """Of two sets of a region, ``other_`` before the names of one's columns: what two linked sets fulfil in some region.

    The first shingle that two sets share, by any order, has behind it in both all others they
    share. And the sketches of two sets, if they are there, differ in no more than the sets, the most that
    two linked ones can differ in follows from their sizes.
    """
    sizes = F.col("size") + F.col("other_size")
    enough = [(F.col(s) - F.col(p) + 1) * (100 + percent) >= percent * sizes for s, p in (("size", "pos"), ("other_size", "other_pos"))]
    if not sketched:
        return enough[0] & enough[1]
    apart = sum((F.abs(F.col("sketch")[i].cast("int") - F.col("other_sketch")[i].cast("int")) for i in range(SKETCH)), F.lit(0))
    return enough[0] & enough[1] & (apart * (100 + percent) <= sizes * (100 - percent))


def not_alone(percent: int) -> Column:
    """Whether a point could be linked with one of the region's ``least`` size.

    A point whose shingles that are rarer than the region's are already more than two linked sets
    can differ in has its partners elsewhere, if any.
    """
    return (F.col("size") - F.col("pos") + 1) * (100 + percent) >= percent * (F.col("size") + F.col("least"))


def alive(regions: DataFrame, percent: int) -> DataFrame:
    """The rows of regions but for points that could be linked with none of the region, not even with one of its least size."""
    dealt = regions.repartition("region")
    least = dealt.groupBy("region").agg(F.min("size").alias("least"))
    return dealt.join(least.hint("merge"), "region").where(not_alone(percent)).drop("least")


def pairs_within(regions: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``a < b`` of points of a region that may be linked and aren't of one class; for regions of a few points.

    ``sketches`` has ``key, sketch`` of all points.
    """
    regions = regions.select("region", "key", "size", "pos", "root").join(sketches, "key").repartition("region")
    met = (F.col("key") < F.col("other_key")) & (F.col("root") != F.col("other_root"))
    pairs = regions.join(as_other(regions), "region").where(met & may_link(percent))
    return pairs.select(F.col("key").alias("a"), F.col("other_key").alias("b"))


def pairs_with(regions: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """``a < b`` of a point of a region and a chosen one there that may be linked and aren't of one class.

    Both have ``region, key, size, pos, root``, and ``sketch`` if it is to be looked at.
    """
    met = (F.col("key") != F.col("other_key")) & (F.col("root") != F.col("other_root"))
    pairs = regions.join(at_hand(as_other(chosen), CHOSEN_ROWS), "region").where(met & may_link(percent, "sketch" in regions.columns))
    return pairs.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b"))


def central() -> Column:
    """Least at the central point of a region."""
    return F.struct("pos", F.xxhash64("key").alias("drawn"), "key")


def with_central(regions: DataFrame) -> DataFrame:
    """Regions with ``central``, whether a point has the rarest place of the region's shingle, as active ones come with."""
    if "central" in regions.columns:
        return regions
    first = F.min(central()).over(Window.partitionBy("region"))
    return regions.withColumn("central", first["key"] == F.col("key"))


def as_other(regions: DataFrame) -> DataFrame:
    return regions.select("region", *[F.col(c).alias(f"other_{c}") for c in regions.columns if c != "region"])


def drawn_outside(turn: int, about: int) -> Column:
    """Whether a point of an active region is outside its largest class and among ``about`` drawn there, all if they are no more.

    Drawn by hash, the same points in regions that hold the same ones.
    """
    unit = 1 << 30
    return F.col("apart") & (F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(unit)) * F.col("outside") < about * unit)


def active(regions: DataFrame, classes: DataFrame | None, scratch: Scratch, once: bool = False) -> DataFrame:
    """The rows of regions with points of more than one class, with their ``root``; written.

    Beside it the region's ``points``, how many of them are ``outside`` its largest class, and
    ``apart`` and ``central``, whether this one is, and whether it has the rarest place of the region's shingle.
    ``classes`` has ``key, root``; without it each point is a class.

    A passage of many shingles brings the same points together as often. With ``once``, of regions of the
    same points, told by 128 bits of their keys, only that of the first places stays: in one order of all
    shingles its places are the least of each point, so what they rule out the others rule out too.
    """
    known = regions.join(at_hand(classes), "key", "left") if classes else regions.withColumn("root", F.col("key"))
    # dealt once, for both sums and the join with them
    known = known.withColumn("root", F.coalesce("root", "key")).repartition("region")
    marks = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"mark_{i}") for i in range(2)]
    sums = [F.count("*").alias("n"), F.min(central()).alias("first"), F.sum("pos").alias("places"), *marks]
    by_class = known.groupBy("region", F.xxhash64("root").alias("mark")).agg(*sums)
    sums = [F.sum("n").alias("points"), F.max(F.struct("n", "mark")).alias("main"), F.min("first").alias("first"), F.sum("places").alias("places")]
    mixed = by_class.groupBy("region").agg(*sums, *[F.bit_xor(f"mark_{i}").alias(f"mark_{i}") for i in range(2)])
    mixed = mixed.where(F.col("points") > F.col("main.n"))
    of_region = ["region", "points", (F.col("points") - F.col("main.n")).alias("outside"), F.col("main.mark").alias("mark"), F.col("first.key").alias("first")]
    if once:
        one = F.min(F.struct("places", *of_region)).alias("one")
        mixed = mixed.groupBy("points", "mark_0", "mark_1").agg(one).select("one.*").drop("places")
    else:
        mixed = mixed.select(*of_region)
    found = known.join(mixed.hint("merge"), "region")
    found = found.withColumns({"apart": F.xxhash64("root") != F.col("mark"), "central": F.col("key") == F.col("first")})
    return scratch(found.drop("mark", "first"))


class Points:
    """The sets that may be linked with another, and what is known of them so far.

    ``places`` has ``key, doc_id, text_key``: of each set wanted the row it is read from.
    """

    def __init__(self, docs: DataFrame, n: int, places: DataFrame, percent: int, scratch: Scratch):
        self.percent, self.scratch = percent, scratch
        self.sets = sets_of(docs, n, scratch(places), scratch)
        #: By point that isn't the smallest of its class, the smallest.
        self.classes = scratch(docs.sparkSession.createDataFrame([], "key binary, root binary"))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """``a, b, common, total`` of written, different pairs, by their whole sets; written."""
        ends = pairs.select(F.col("a").alias("key"))
        if is_few(pairs):
            a, b, pairs = self.sets.join(F.broadcast(ends), "key", "left_semi"), self.sets, F.broadcast(pairs)
        else:
            a, b = self._among(ends), self._among(pairs.select(F.col("b").alias("key")))
        a, b = a.toDF("a", "grams_a"), b.toDF("b", "grams_b")
        common = F.array_size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("common")
        sizes = (F.array_size("grams_a") + F.array_size("grams_b")).cast("long").alias("sizes")
        both = b.join(pairs, "b").join(a.hint("merge"), "a")
        both = both.select("a", "b", common, sizes)
        return self.scratch(both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total")))

    def _among(self, keys: DataFrame) -> DataFrame:
        """The sets of the keys, and a few others; the others are not shuffled."""
        return marked(self.sets, self.scratch(marks(keys, "key")), "key").where("maybe").drop("maybe")

    def merge(self, compared: DataFrame) -> None:
        """Makes one class of the classes that are linked."""
        links = compared.where(linked(self.percent))
        links = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        if not links.isEmpty():
            self.classes = classes(links.unionByName(self.classes.toDF("high", "low")), self.scratch)

    def active(self, regions: DataFrame, once: bool = False) -> DataFrame:
        return active(regions, self.classes, self.scratch, once)

    def rare_regions(self, points: DataFrame, turn: int) -> DataFrame:
        """``region, key, size, pos``: points by those of their shingles that are rarest among these points.

        ``points`` has ``key, size``, each point once. Of each there is one shingle more
        than two linked sets can differ in, but for those that no other point has.
        """
        wanted = at_hand(self.scratch(points))
        grams = self.sets.join(wanted, "key").select("key", "size", F.explode("grams").alias("gram")).repartition("gram")
        # by all columns, so that one shuffle serves both sides of the join
        mark = F.xxhash64("key", "size")
        often = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min(mark).alias("x"), F.max(mark).alias("y"))
        often = often.where(F.col("x") != F.col("y")).drop("x", "y")
        held = grams.join(often.hint("merge"), "gram").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("held"))
        kept = F.col("size") - F.ceil(F.col("size") * self.percent / 100) + 1
        alone = F.col("size") - F.array_size("held")
        first = F.slice("held", F.lit(1), F.greatest(kept - alone, F.lit(0)).cast("int"))
        found = held.select("key", "size", alone.alias("alone"), F.posexplode(first).alias("i", "rare"))
        region = F.xxhash64("rare.gram", F.lit(turn))
        found = found.select(region.alias("region"), "key", "size", (F.col("alone") + F.col("i") + 1).cast("int").alias("pos"))
        return alive(found, self.percent)


def sets_of(docs: DataFrame, n: int, places: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, grams`` of the sets of the texts at the given places, and of a few others, each once; written."""
    schema = pa.schema([("key", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = {}
            for text in texts(batch):
                own = shingles(text, n)
                found[keyed(own)] = own
            found = {k: x for k, x in found.items() if k not in seen}
            seen.update(found)
            offsets = np.cumsum([0, *[len(x) for x in found.values()]]).astype(np.int32)
            grams = pa.ListArray.from_arrays(offsets, np.concatenate([*found.values(), np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), grams], schema=schema)

    # texts are not shuffled: those of a few other rows do no harm, as sets are asked for by key
    wanted = marked(shingled(docs), scratch(marks(places, "doc_id", "text_key")), "doc_id", "text_key").where("maybe")
    return scratch(wanted.select("text").mapInArrow(run, "key binary, grams array<long>").dropDuplicates(["key"]))


def classes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, root``: of each point of a graph that isn't the smallest of its component, the smallest.

    ``high`` and ``low`` are the ends of edges. Each turn gives the larger neighbours of a point its
    smallest neighbour, then the point itself and its smaller ones, until all edges lead to the root.
    Only smallest values are gathered, so a point with very many edges is no task of its own.
    """
    edges = scratch(edges.distinct())
    while True:
        near = F.broadcast if edges.count() <= BROADCAST_ROWS // 2 else lambda rows: rows
        if settled(edges, near):
            return edges.toDF("key", "root")
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least"))
        least = least.select("high", F.least("high", "least").alias("least"))
        large = both.join(near(least), "high").where(F.col("low") > F.col("high")).select(F.col("low").alias("high"), F.col("least").alias("low"))
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(near(least), "high").select("high", F.array_distinct(F.array("high", "low")).alias("ends"), "least")
        small = small.select(F.explode("ends").alias("high"), F.col("least").alias("low"))
        edges = scratch(small.where(F.col("high") != F.col("low")).distinct())


def settled(edges: DataFrame, near: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether each edge leads to a root: none has an edge itself, and no point has two."""
    if not edges.select(F.col("low").alias("high")).join(near(edges.select("high")), "high", "left_semi").isEmpty():
        return False
    return edges.groupBy("high").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()


def by_class(rows: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of rows with ``doc_id, key, size, root``."""
    # smallest ids first by set, so that what a class gathers is bounded by its different sets
    least = rows.where(F.col("key").isNotNull()).groupBy("key", "root").agg(F.min("doc_id").alias("least"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rows.join(by_root, "root", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
