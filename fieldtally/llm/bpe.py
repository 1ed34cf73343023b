"""BPE encoding and decoding by a contiguous array of ranks.

A word is held as the list of its part boundaries with, beside it, the rank of each adjacent pair
of parts. The smallest rank is found by scanning, its inner boundary deleted, and the ranks on
either side refreshed, until no pair can be merged. The arrays of all new words of some texts lie
side by side in numpy, and take their steps together. Scanning is quadratic in the length of a
word, so words beyond ``SHORT`` bytes take their pairs from a heap, with the same result.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldtally.llm.common import by_size, texts

#: Bytes up to which a word is merged by scanning.
SHORT = 96
#: Chunks kept encoded per Python worker, twice at most, and the longest that is kept.
KEPT, KEPT_CHARS = 40_000, 48
#: Characters encoded at once; a longer text is encoded alone.
AT_ONCE = 1 << 18
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class PairTable:
    """Rank and merged id of pairs of ids, looked up for whole arrays: open addressing in numpy."""

    SIZE = 1 << 19

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.keys = np.full(self.SIZE, -1, np.int64)
        self.values = np.full(self.SIZE, NONE, np.int64)
        for (a, b), value in pairs.items():
            at = int(self._slot(np.array([a << BITS | b]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % self.SIZE
            self.keys[at], self.values[at] = a << BITS | b, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B97F4A7C1) >> 20) % self.SIZE

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << BITS | merged id``, ``NONE`` where the pair can't be merged."""
        keys = left.astype(np.int64) << BITS | right
        at = self._slot(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], NONE)
        (rest,) = np.nonzero((there != keys) & (there >= 0))
        while rest.size:
            at[rest] = (at[rest] + 1) % self.SIZE
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return found


class WordBPE:
    """Encoder and decoder for a vocabulary file with word ends, as the tokenizers library reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.added).items()}
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int64)
        #: Of a pair of ids: its rank, and in the lower ``BITS`` bits the id of what it merges to.
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), rank << BITS | vocab[a + b])
        self.table = PairTable(self.ranks)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of 1 to ``SHORT`` bytes, all words a step at a time."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts, column = self.inner[raw], np.arange(width)
        every = np.arange(len(words))
        parts[every, lengths - 1] = self.last[raw[every, lengths - 1]]
        ranks = np.full((len(words), width), NONE, np.int64)
        pair = column[None, :] < lengths[:, None] - 1
        ranks[pair] = self.table(parts[pair], np.roll(parts, -1, 1)[pair])
        left = every  # the words that may still be merged
        while left.size:
            least = ranks[left].min(1)
            left, least = left[least < NONE], least[least < NONE]
            if not left.size:
                break
            i = ranks[left].argmin(1)
            shift = np.minimum(column + (column > i[:, None]), width - 1)
            moved = np.take_along_axis(parts[left], shift, 1)
            rank = np.take_along_axis(ranks[left], np.minimum(column + (column >= i[:, None]), width - 1), 1)
            rank[:, -1] = NONE
            here, size = np.arange(left.size), lengths[left] - 1
            moved[here, i] = least & MASK
            for at, there in ((i - 1, i > 0), (i, i < size - 1)):
                rows, at = here[there], at[there]
                rank[rows, at] = self.table(moved[rows, at], moved[rows, at + 1])
            parts[left], ranks[left], lengths[left] = moved, rank, size
        return [p[:n] for p, n in zip(parts, lengths.tolist())]

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word, its pairs taken from a heap; for words where scanning would be quadratic."""
        parts = self.inner[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.ranks.get((parts[i], parts[j]))) is not None:
                heapq.heappush(waiting, (found, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            found, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = found & MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as little-endian bytes."""
        done: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for word in words:
            raw = word.encode()
            if len(raw) <= SHORT:
                by_width[-(-len(raw) // 4)].append((word, raw))
            else:
                done[word] = self._packed(self.merge_long(raw))
        for group in by_width.values():
            merged = self.merge_short([raw for _, raw in group])
            done.update((word, self._packed(ids.tolist())) for (word, _), ids in zip(group, merged))
        return done

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks, runs without white space, that aren't known yet."""
        new = [c for c in chunks if c not in self.kept]
        self.kept.update({c: self.older[c] for c in new if c in self.older})
        words = {c: self.split(c) for c in new if c not in self.kept}
        merged = self.merge(list({w for ws in words.values() for w in ws}))
        for chunk, ws in words.items():
            found = [merged[w] for w in ws]
            self.kept[chunk] = found[0] if len(found) == 1 else b"".join(found)

    def chunks(self, text: str | None) -> list[str]:
        """The runs of a text without white space; a special token has a blank before it."""
        text, at, found = text or "", 0, []
        for special in self.special.finditer(text):
            found += [*self._plain(text[at : special.start()]), " " + special[0]]
            at = special.end()
        return found + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without context
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split alone
            return [x for x in regex.split(r"\s+", text) if x]
        return text.split()

    def encode(self, batch: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text its ids as little-endian 32-bit integers, and the text they decode to."""
        split = [self.chunks(t) for t in batch]
        self.learn({c for chunks in split for c in chunks if c[0] != " "})
        self.kept.update({" " + t: self._packed([i]) for t, i in self.added.items()})
        done = []
        for chunks in split:
            ids = b"".join(map(self.kept.__getitem__, chunks))
            done.append((ids, self.decode(ids)))
        if len(self.kept) > KEPT:
            self.older = {c: x for c, x in self.kept.items() if len(c) <= KEPT_CHARS}
            self.kept = {}
        return done

    def decode(self, ids: bytes) -> str:
        """The text of ids, tokens joined by blanks, as a vocabulary without a decoder gives it."""
        return " ".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """One per Python worker and file."""
    return WordBPE(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every whole text, with the vocabulary file at ``path``.

    The file must lie at the same place on all machines. A null text is taken as empty: no ids,
    empty decoded text. Very long texts are encoded whole, alone. Repeated rows give repeated results; other columns are not looked at; an
    empty table gives an empty one. Each row is encoded alone, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at = 0
            for some in by_size(texts(batch), AT_ONCE):  # ids and text go on as soon as they are made
                done = bpe.encode(some)
                ids, shown = [x[0] for x in done], [x[1] for x in done]
                columns = [batch.column("doc_id").slice(at, len(some)), pa.array([len(x) // 4 for x in ids]), pa.array(ids), pa.array(shown)]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, SCHEMA)], schema=SCHEMA)
                at += len(some)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
