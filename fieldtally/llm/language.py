"""Language identification by averaged hashed subword embeddings and a linear softmax.

The subwords of a text are the runs of one to four characters of its lower-cased words, word ends
included. Each is hashed to a row of an embedding; the mean of the rows goes through a linear
layer. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents. One part of the sample is not trained on: it gives the temperature that makes the
softmax a probability, and the probability below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.characters import code_points, ngram_hashes, property_table, slices
from fieldtally.llm.common import by_size, texts

SIZES, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 14, 16
#: Documents the model is fitted on, about so many of each language, and languages at most.
PER_LANGUAGE, LANGUAGES = 300, 200
#: Passes over the sample, and the first step size of the embedding; the linear layer takes a hundredth of it.
EPOCHS, RATE = 12, 200.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  #: by bucket and language, what a subword adds to the mean
    bias: np.ndarray
    temperature: float
    least: float  #: score below which a prediction is rejected


def subwords(batch: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of texts, and of their subwords the place in that list and the bucket."""
    letter = property_table("isalpha")
    for owners, parts in slices(batch):
        points, owner = code_points([" " + p.lower() for p in parts])
        points = np.where(letter[points], points, 32).astype(np.uint64)
        blank = points == 32
        kept = ~(blank & np.concatenate([[False], blank[:-1]]) & (owner == np.concatenate([[-1], owner[:-1]])))
        points, owner, blank = points[kept], owner[kept], blank[kept]
        places, buckets = [], []
        for n in SIZES:
            found = ngram_hashes(points, n, BUCKETS)
            inner = np.zeros(len(found), bool)
            for i in range(1, max(n - 1, 1)):
                inner |= blank[i : i + len(found)]
            if n < 3:
                inner = blank[: len(found)] if n == 1 else blank[: len(found)] & blank[1:]
            places.append(owner[min(n - 1, 1) :][: len(found)][~inner])
            buckets.append(found[~inner])
        yield owners, np.concatenate(places), np.concatenate(buckets)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(model: Model, batch: list[str]) -> np.ndarray:
    """By text and language, the calibrated probability."""
    sums, counts = np.zeros((len(batch), len(model.languages))), np.zeros(len(batch))
    for owners, places, buckets in subwords(batch):
        n = len(owners)
        counts += np.bincount(owners, np.bincount(places, minlength=n), len(batch))
        for j in range(sums.shape[1]):
            part = np.bincount(places, model.table[buckets, j], n)
            sums[:, j] += np.bincount(owners, part, len(batch))
    means = sums / np.maximum(counts, 1)[:, None] + model.bias
    return probabilities(means / model.temperature)


class Shares:
    """By document and bucket the share of its subwords, as a matrix of which only some rows are ever whole."""

    def __init__(self, buckets: list[np.ndarray], shares: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, buckets)])
        self.buckets = np.concatenate([*buckets, np.zeros(0, np.int32)])
        self.shares = np.concatenate([*shares, np.zeros(0, np.float32)])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros((len(rows), BUCKETS), np.float32)
        for row, first, end in zip(found, self.ends[rows], self.ends[rows + 1]):
            row[self.buckets[first:end]] = self.shares[first:end]
        return found


def train(vectors: Shares, labels: np.ndarray, languages: list[str], checks: np.ndarray, seed: int = 7) -> Model:
    """A model of the documents' shares and languages; ``checks``: documents not trained on."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    rows = np.flatnonzero(~checks)
    steps = range(EPOCHS)
    for epoch in steps:
        rate = RATE * (1 - epoch / len(steps))
        for some in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            x = vectors[some]
            hidden = x @ embedding
            error = probabilities(hidden @ weights + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            error = (error / max(1, len(some))).astype(np.float32)
            back = error @ weights.T
            weights -= rate / 100 * hidden.T @ error
            bias -= rate / 100 * error.sum(0)
            embedding -= rate * x.T @ back
    held = np.flatnonzero(checks) if checks.any() else rows
    means = np.vstack([vectors[some] @ embedding for some in np.array_split(held, len(held) // 256 + 1)])
    logits, truth = means @ weights + bias, labels[held]

    # a few checks without an error don't make a certainty: targets are smoothed by their number
    targets = np.full(logits.shape, 1 / (len(held) + 2) / max(1, len(languages) - 1))
    targets[np.arange(len(held)), truth] = 1 - 1 / (len(held) + 2)

    def loss(t: float) -> float:
        return -(targets * np.log(probabilities(logits / t) + 1e-12)).sum()

    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = probabilities(logits / temperature)
    right, score = p.argmax(1) == truth, p.max(1)
    # the least score above which no more than one in a hundred is wrong
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(held) + 1)
    good = np.flatnonzero(errors <= 0.01)
    least = float(score[order][good[-1]]) if good.size else 1.0
    return Model(languages, (embedding @ weights).astype(np.float32), bias.astype(np.float64), temperature, least)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from ``doc_id, text, lang``; ``None`` if no row has both a text and a language.

    It is fitted on about ``per_language`` documents of each language, all if there are fewer,
    chosen by a hash of their ids. What the driver gets is bounded by that number, ``LANGUAGES``
    and ``BUCKETS``; more languages than ``LANGUAGES`` are an error.
    """
    known = labelled.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    known = known.select("doc_id", "text", F.col("lang").alias("language"))
    counts = {r[0]: r[1] for r in known.groupBy("language").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)])
    drawn = (F.xxhash64(F.col("doc_id"), F.lit("fit")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    part = (F.xxhash64(F.col("doc_id"), F.lit("check")) % 5 == 0).alias("held")
    sample = known.where(drawn < F.element_at(share, F.col("language"))).select("text", "language", part)
    schema = pa.schema([
        ("language", pa.string()), ("held", pa.bool_()),
        ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch):
                total = np.zeros(BUCKETS)
                for _, _, buckets in subwords([text]):
                    total += np.bincount(buckets, minlength=BUCKETS)
                (own,) = np.nonzero(total)
                found.append((own.astype(np.int32), (total[own] / max(total.sum(), 1)).astype(np.float32)))
            columns = [batch.column("language"), batch.column("held")]
            columns += [pa.array([f[i] for f in found], schema.types[2 + i]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = sample.mapInArrow(run, "language string, held boolean, buckets array<int>, shares array<float>").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort([hash_of(b.as_py(), s.as_py()) for b, s in zip(rows["buckets"], rows["shares"])], kind="stable")
    vectors = Shares(*([rows[c][k].values.to_numpy() for k in order.tolist()] for c in ("buckets", "shares")))
    labels = np.array([languages.index(x) for x in rows["language"].to_pylist()])[order]
    return train(vectors, labels, languages, np.array(rows["held"].to_pylist(), bool)[order])


def hash_of(buckets: list[int], shares: list[float]) -> tuple:
    """Rows in one order however they arrived."""
    return sum(b * s for b, s in zip(buckets, shares))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every whole text.

    ``lang_pred`` is a language of the model, and ``und`` with score 0, not accepted, where the
    text is null or empty or has no letter, and everywhere without a model. ``accepted`` is false
    where the calibrated score is below the model's limit. Very long texts are judged whole, some
    characters at a time. Repeated rows give repeated results, an empty table an empty one; other
    columns are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, accepted = [], [], []
            for some in by_size(texts(batch), 1 << 20):
                some = [t or "" for t in some]
                found = predict(model, some) if model else np.zeros((len(some), 1))
                for text, p in zip(some, found):
                    known = model is not None and has_letter(text)
                    names.append(model.languages[int(p.argmax())] if known else UNKNOWN)
                    scores.append(float(p.max()) if known else 0.0)
                    accepted.append(known and scores[-1] >= model.least)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
