"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text's features are its hashed words, the hashed runs of one to three character classes, each run
of small letters taken as one, and a few measures of its length, repetition and layout. A truncated singular value decomposition of a bounded
sample of labelled documents, done in numpy, gives the space. The vectors of that sample are
broadcast; every document's cosines with all of them are computed exactly, a block of documents
at a time, and the labels of the nearest vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.characters import code_points, ngram_hashes, property_table, slices
from fieldtally.llm.common import by_size, texts

SIZES, BUCKETS, WIDTH = (1, 2, 3), 1 << 12, 48
#: Places of hashed words, and their weight beside the runs of classes, which are of the same length.
TERMS, TERM_WEIGHT = 1 << 11, 0.5
#: A longer word, as of a script without blanks, counts by its runs of ``PIECE`` characters.
LONG, PIECE = 24, 3
#: About so many labelled documents make the space and vote, all if there are fewer.
LABELLED = 3000
NEIGHBOURS, SHARPNESS = 15, 12.0
MEASURES = 7
#: Texts, and characters of several texts, that are scored at once; a text has some thousand features.
SCORED, SCORED_CHARS = 64, 1 << 17
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  #: by feature
    centre: np.ndarray
    axes: np.ndarray  #: by feature and dimension of the space
    vectors: np.ndarray  #: of the labelled documents, of length 1
    labels: np.ndarray
    prior: float


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """By code point: small letter 1, capital 2, digit 3, blank 4, line end 5, all else one of 6 to 127."""
    table = np.resize(np.arange(6, 128, dtype=np.uint8), 0x110000)
    for name, value in (("isspace", 4), ("isalpha", 1), ("isupper", 2), ("isdigit", 3)):
        table[property_table(name)] = value
    table[10] = 5
    return table


@lru_cache(maxsize=1)
def run_buckets() -> list[np.ndarray]:
    """By run of one, two or three classes, seven bits each, its bucket; made in parts, as a worker keeps what it once needed."""
    found = [np.empty(1 << 7 * n, np.uint16) for n in SIZES]
    for n, buckets in zip(SIZES, found):
        for at in range(0, len(buckets), 1 << 16):
            part = buckets[at : at + (1 << 16)]
            part[:] = ngram_hashes(np.arange(at, at + len(part), dtype=np.uint64) + np.uint64(n << 40), 1, BUCKETS)
    return found


def measures(text: str) -> list[float]:
    """Length, repetition and layout, each from 0 to 1."""
    words = text.split()
    if not words:
        return [0.0] * MEASURES
    counts = Counter(words)
    n, lines = len(words), text.split("\n")
    return [
        min(1.0, np.log1p(n) / 10),
        1 / (1 + n / 8),
        len(counts) / n,
        max(counts.values()) / n,
        len(set(lines)) / len(lines),
        sum(map(eq, words, words[1:])) / n,
        min(1.0, len(text) / n / 20),
    ]


@lru_cache(maxsize=1 << 14)
def term_place(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) % TERMS


def terms(text: str) -> np.ndarray:
    """By place: how many of the text's words are hashed there, upper and lower case alike."""
    counts = np.zeros(TERMS)
    for word, n in Counter(WORD.findall(text.lower())).items():
        for term in [word] if len(word) <= LONG else [word[i : i + PIECE] for i in range(len(word) - PIECE + 1)]:
            counts[term_place(term)] += n
    return counts


def shares(counts: np.ndarray) -> np.ndarray:
    """By text: shares under a square root, of length 1; zero stays zero."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def features(batch: list[str]) -> np.ndarray:
    """By text and feature: shares of hashed runs and of hashed words, then the measures."""
    counts = np.zeros(len(batch) * BUCKETS)
    for owners, parts in slices(batch):
        points, owner = code_points(parts)
        kind = class_table()[points]
        same = np.concatenate([[False], (kind[1:] == 1) & (kind[:-1] == 1)])  # a run of small letters counts once
        kind, at = kind[~same].astype(np.int64), (np.array(owners) * BUCKETS)[owner[~same]]
        run = np.zeros_like(kind)
        for n, buckets in zip(SIZES, run_buckets()):
            run = (run[: len(kind) - n + 1] << 7) | kind[n - 1 :] if n > 1 else kind
            inside = at[: len(run)] == at[n - 1 :]  # no run reaches into the next text
            counts += np.bincount((at[: len(run)] + buckets[run])[inside], minlength=counts.size)
    found = [shares(counts.reshape(len(batch), BUCKETS)), TERM_WEIGHT * shares(np.array([terms(t) for t in batch]).reshape(-1, TERMS))]
    return np.hstack([*found, np.array([measures(t) for t in batch]).reshape(-1, MEASURES)]).astype(np.float32)


def embed(model: Model, found: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in the latent space; zero stays zero."""
    vectors = (found * model.idf - model.centre).astype(np.float64) @ model.axes
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def votes(model: Model, vectors: np.ndarray, without_self: bool = False) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by cosine; the cosines are exact."""
    cosines = vectors @ model.vectors.T
    if without_self:
        np.fill_diagonal(cosines, -2)
    k = min(NEIGHBOURS, cosines.shape[1])
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(cosines, nearest, 1)
    weights = np.exp(SHARPNESS * (near - 1))
    weights[near < -1] = 0
    # one vote for the share of label 1 among all, so that weak neighbours decide nothing alone
    given = (weights * model.labels[nearest]).sum(1) + model.prior * 1e-3
    return given / (weights.sum(1) + 1e-3)


def fit(labelled: DataFrame, at_most: int = LABELLED) -> Model | None:
    """A model from ``doc_id, text, quality``; ``None`` if no row has a text and a quality of 0 or 1.

    Fitted on about ``at_most`` rows, chosen by a hash of their ids; only their features come to
    the driver, ``at_most`` times a fixed number.
    """
    known = labelled.where(F.col("quality").isin(0, 1) & F.col("text").isNotNull()).select("doc_id", "text", F.col("quality").cast("int").alias("label"))
    n = known.count()
    if not n:
        return None
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_003)) / 1_000_003
    schema = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("at", pa.binary()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for text in texts(batch):
                row = features([text])[0]
                (there,) = np.nonzero(row)
                at.append(there.astype(np.uint16).tobytes())
                found.append(row[there].tobytes())
            columns = [batch.column("label"), batch.column("doc_id"), pa.array(at, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sample = known.where(drawn < at_most / n).select("label", F.col("doc_id").cast("long"), "text")
    rows = sample.mapInArrow(run, "label int, doc_id long, at binary, found binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "found", "label")])
    matrix = np.zeros((rows.num_rows, BUCKETS + TERMS + MEASURES), np.float32)
    for row, at, found in zip(matrix, rows["at"], rows["found"]):
        row[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(found.as_py(), np.float32)
    labels = rows["label"].to_numpy().astype(np.float32)
    del rows
    return train(matrix, labels)


def blocks(matrix: np.ndarray, size: int = 256) -> Iterator[np.ndarray]:
    """The rows of a matrix, some at a time, so that what is computed of them stays small."""
    return (matrix[i : i + size] for i in range(0, len(matrix), size))


def train(found: np.ndarray, labels: np.ndarray) -> Model:
    """The space by singular value decomposition, and the labelled vectors in it.

    ``found`` is the one matrix of its size: all else is computed by blocks of its rows.
    """
    present = sum((block > 0).sum(0) for block in blocks(found))
    idf = np.log(1 + len(found) / (1 + present)).astype(np.float32)
    idf[-MEASURES:] = 1
    centre = (sum((block * idf).sum(0, dtype=np.float64) for block in blocks(found)) / len(found)).astype(np.float32)
    axes, spread = singular_vectors(found, idf, centre, WIDTH)
    scaled = axes / np.sqrt(np.maximum(spread, 1e-6))  # half way to equal spread
    space = Model(idf, centre, scaled, np.zeros((0, 0)), labels, float(labels.mean()))
    return replace(space, vectors=np.vstack([embed(space, block) for block in blocks(found)]))


def singular_vectors(found: np.ndarray, idf: np.ndarray, centre: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of ``found * idf - centre`` as columns, and singular values, by iteration of a random subspace."""
    width, size = min(width, *found.shape), found.shape[1]
    probe = np.random.default_rng(7).normal(size=(size, min(width + 16, size)))
    weighed = lambda: ((block * idf - centre).astype(np.float64) for block in blocks(found))
    for _ in range(4):
        probe, _ = np.linalg.qr(sum(block.T @ (block @ probe) for block in weighed()))
    _, spread, turned = np.linalg.svd(np.vstack([block @ probe for block in weighed()]), full_matrices=False)
    return (probe @ turned.T)[:, :width], spread[:width]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every whole text: the votes for quality 1, from 0 to 1.

    A null text is scored as an empty one, which has features like any other. Without a model each
    score is 0.5. Very long texts are scored whole, some characters at a time. Repeated rows give
    repeated results, an empty table an empty one; other columns are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    scored = score_batches(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scored(batch)], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double")


def score_batches(spark, model: Model | None):
    """A function from a batch with ``text`` to its scores, the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> pa.Array:
        model, scores = shared.value, []
        for some in by_size(texts(batch), SCORED_CHARS):
            for at in range(0, len(some), SCORED):
                block = [t or "" for t in some[at : at + SCORED]]
                found = votes(model, embed(model, features(block))) if model else np.full(len(block), 0.5)
                scores.append(np.round(np.clip(found, 0, 1), 9))  # sums differ in the last digits with the block
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    return scored


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all their columns as they were."""
    scored, columns = score_batches(docs.sparkSession, model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED):
                some = batch.slice(at, SCORED)
                yield some.filter(pa.array(np.asarray(scored(some)) >= least))

    return docs.mapInArrow(run, columns)
