"""Benchmark decontamination: an FM-index of each shard of documents, searched for benchmark phrases.

A shard is a run of documents of a partition. Its text is written as numbers of benchmark words;
what lies between other words and is shorter than any phrase can hold none and is left out.
All phrases are searched backward at once through the ranks of a wavelet matrix, and their
occurrences located by sampled suffix positions. The words they cover are merged to spans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.common import by_size, texts, written
from fieldtally.llm.fm_index import FMIndex

#: Words of a phrase. Characters of a shard, and of the benchmark items searched for in one pass.
WINDOW, SHARD, BLOCK = 10, 4 << 20, 4 << 20
NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
BLANKED = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPANS = "array<struct<first:int,last:int>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters a-z after A-Z are lower-cased, and all beyond ASCII."""
    return (text or "").encode("utf-8", "replace").lower().translate(BLANKED).split()


@dataclass(frozen=True)
class Phrases:
    """The different windows of some items, as rows of word numbers."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    owners: list[list[int]]  #: by phrase, the numbers of its items

    @staticmethod
    def of(items: list[tuple[str, str]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found[tuple(ids[i : i + window])].add(number[name])
        rows = np.zeros((len(found), window), np.int64)
        for i, phrase in enumerate(found):
            rows[i, : len(phrase)] = phrase
        return Phrases(vocabulary, rows, np.array([len(p) for p in found], np.int64), names, [sorted(x) for x in found.values()])


def search(phrases: Phrases, shard: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text its number of words, the spans of words that phrases cover, and the items found."""
    get, parts = phrases.vocabulary.get, []
    for text in shard:
        own = words(text)
        parts.append(np.fromiter(map(get, own, repeat(0)), np.int32, len(own)))
    n_words = [len(p) for p in parts]
    spans: list[list[tuple[int, int]]] = [[] for _ in shard]
    items: list[list[str]] = [[] for _ in shard]
    if not len(phrases.rows):
        return n_words, spans, items
    end = np.zeros(1, np.int32)
    whole = np.concatenate([x for p in parts for x in (p, end)] or [end])
    starts = np.cumsum([0] + [n + 1 for n in n_words])[:-1]
    symbols, origin = runs(whole, int(phrases.lengths.min()))
    if not len(symbols):
        return n_words, spans, items
    index = FMIndex(symbols)
    low, high = index.search(phrases.rows, phrases.lengths)
    times = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(times)), times)
    suffix = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[phrase]
    at = origin[index.locate(suffix)]
    doc = np.searchsorted(starts, at, "right") - 1
    edges = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.lengths[phrase], -1)
    hit = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]) - 1
    for a, b, d in zip(first.tolist(), last.tolist(), (np.searchsorted(starts, first, "right") - 1).tolist()):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    seen: dict[int, set[int]] = defaultdict(set)
    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
        seen[d].update(phrases.owners[p])
    for d, own in seen.items():
        items[d] = [phrases.items[i] for i in sorted(own)]
    return n_words, spans, items


def runs(whole: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``least`` symbols or more that aren't 0, a 0 after each, and where in ``whole`` each symbol stands."""
    known = np.concatenate([[False], whole > 0, [False]])
    first, behind = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long = behind - first >= least
    first, size = first[long], behind[long] - first[long] + 1  # the 0 behind it goes along
    origin = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    symbols = np.concatenate([whole, [0]])[origin].astype(np.int64)
    return symbols, origin


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two lists of spans as one, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words, each cut from its first to its last word."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[Phrases, bool]]:
    """Phrases of the benchmark, in blocks of about ``BLOCK`` characters, so that none grows with the table, and whether it is the last."""
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("words"))
    known = known.where(F.col("item").isNotNull() & F.col("words").isNotNull())
    size = known.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for i in range(n):
        part = known.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i)
        yield Phrases.of([(r[0], r[1]) for r in part.distinct().collect()], window), i == n - 1


def scan(df: DataFrame, benchmark: DataFrame, window: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, kind: T.StructType | None = None) -> DataFrame:
    """``df``, which has ``text``, with ``n_words, spans, items`` added, block after block of the benchmark.

    With ``finish``, what it makes of such batches, rows of ``kind``. It is called where the last block is searched for: a
    Python function after that would take another worker for each core, and an executor keeps these for what follows.
    """
    context = df.sparkSession.sparkContext
    out = df.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])

    def pass_over(shared, finish) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for shard in by_size(texts(batch), SHARD):
                    part = batch.slice(at, len(shard))
                    at += len(shard)
                    n_words, spans, items = search(shared.value, shard)
                    old = [[(s["first"], s["last"]) for s in x] for x in part.column("spans").to_pylist()]
                    spans = [merged(a, b) if a else b for a, b in zip(old, spans)]
                    items = [sorted({*a, *b}) if a else b for a, b in zip(part.column("items").to_pylist(), items)]
                    new = {
                        "n_words": pa.array(n_words, pa.int64()),
                        "spans": pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], SPAN_TYPE),
                        "items": pa.array(items, pa.list_(pa.string())),
                    }
                    columns = [new.get(name, part.column(i)) for i, name in enumerate(part.schema.names)]
                    found = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
                    yield finish(found) if finish else found

        return run

    for phrases, last in blocks(benchmark, window):  # the driver holds one block at a time, and so does a task
        shared = context.broadcast(phrases)
        if last:
            return out.mapInArrow(pass_over(shared, finish), kind if finish else schema)
        out = written(out.mapInArrow(pass_over(shared, None), schema))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every whole text.

    A phrase is ``window`` successive words of a benchmark item, or all words of an item with
    fewer. ``spans`` are the first and last numbers of words inside occurrences, merged, and
    ``items`` the sorted ids, as text, of the items found. A null or empty text has no words; an
    item with a null id or text, or without words, is never found; an empty benchmark finds
    nothing. Very long texts are searched whole, as a shard of their own. Repeated rows give
    repeated results, an empty table of documents an empty one, and other columns are not looked at.

    A benchmark of more than ``BLOCK`` characters is searched for in several passes, the results of
    each but the last written to the shared folder.
    """
    found = scan(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all words inside occurrences of benchmark phrases, and what is between them, cut from ``text``.

    All columns keep their names and order. A null text stays null; otherwise as in
    :func:`find_contamination`.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column("spans").to_pylist()
        new = [without(t, [(s["first"], s["last"]) for s in x]) if x else t for t, x in zip(texts(batch), spans)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    out = scan(packed, benchmark, window, cut, packed.schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
