"""Alignment of two tokenizers over the bytes of texts, and how often their tokens stand for each other.

Byte offsets where tokens of both end cut a text into groups; the last token of either side in a
group is a link. The two tokens of a link end together, so the bytes of one are an end of the
other's: what pairs there can be follows from the two vocabularies, fewer than all their tokens
have bytes. Tables over these pairs are of a fixed size, whatever the corpus.

Most groups are one token on each side. An array by token of the first vocabulary has the token of
the second with the same bytes; such links are counted in a vector of the length of the vocabulary.
Only what is irregular is counted by pair, and the pairs' counts are shuffled. In a second pass
over the links, not the texts, each is looked up in the sums.

A text is cut before each blank or line end that follows no white space, where both tokenizers
begin anew; pieces seen before are not encoded again.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtally.llm.bpe import byte_alphabet
from fieldtally.llm.common import by_size, texts, written

#: Pieces of text a worker keeps aligned, twice at most, and the longest that is kept.
KEPT, KEPT_CHARS = 200_000, 48
#: Characters worked on at once; a longer text is worked on alone.
AT_ONCE = 1 << 19
BLANK = "▁"
CUT = re.compile(r"(?<=\S)(?=[ \n])")

#: Of a piece: tokens of A and B, groups, the groups as text, and the links.
Aligned = tuple[int, int, int, str, bytes]


class Aligner:
    """A byte-level tokenizer file (A) beside a sentencepiece model (B) that puts a blank before a text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = self._bytes_a(path_a), self._bytes_b()
        self.size_a, self.size_b = ([len(x) for x in of] for of in (self.bytes_a, self.bytes_b))
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.kind, self.shift = (np.dtype("<u4"), 16) if size <= 1 << 16 else (np.dtype("<u8"), 32)
        ids: dict[bytes, list[int]] = defaultdict(list)
        for i in sorted(range(len(self.bytes_b)), key=self.b.is_byte):  # a plain piece goes before a byte
            ids[self.bytes_b[i]].append(i)
        #: By token of A the token of B with the same bytes, or -1.
        self.same = np.array([ids[x][0] if x in ids else -1 for x in self.bytes_a], np.int64)
        self.pairs = self._pairs(ids)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.bytes_b))]
        #: No piece goes over a cut, so pieces of text can be encoded apart.
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.blank = self.b.piece_to_id(BLANK)
        self.kept: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def _bytes_a(self, path: str) -> list[bytes]:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = {c: i for i, c in enumerate(byte_alphabet())}
        found = {i: bytes(shown[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        found |= {x["id"]: x["content"].encode() for x in spec["added_tokens"] if x["id"] not in found}
        return [found.get(i, b"") for i in range(max(found) + 1)]

    def _bytes_b(self) -> list[bytes]:
        model, found = self.b, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                found.append(bytes([int(piece[3:5], 16)]))
            else:
                found.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(BLANK, " ").encode())
        return found

    def _pairs(self, ids: dict[bytes, list[int]]) -> np.ndarray:
        """All pairs of tokens of which one's bytes are an end of the other's, as sorted links."""
        own: dict[bytes, list[int]] = defaultdict(list)
        for i, token in enumerate(self.bytes_a):
            own[token].append(i)
        found = set()
        for these, others, turned in ((self.bytes_a, ids, False), (self.bytes_b, own, True)):
            for i, token in enumerate(these):
                for at in range(len(token)):
                    for j in others.get(token[at:], ()):
                        found.add(j << self.shift | i if turned else i << self.shift | j)
        return np.array(sorted(found), self.kind)

    def encode_b(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces of a text, each as it stands there: the blank a piece begins with is the one B adds."""
        plain = [p[1:] if p[0] == " " else p for p in pieces]
        found = self.b.encode(plain, num_threads=1)
        return [[self.blank] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, found)]

    def aligned(self, piece: bytes, a: list[int], b: list[int]) -> Aligned | None:
        """``None`` where the bytes of either side aren't those of the piece."""
        if b"".join(map(self.bytes_a.__getitem__, a)) != piece or b"".join(map(self.bytes_b.__getitem__, b)) != piece:
            return None
        size_a, size_b = self.size_a, self.size_b
        groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        end_a, end_b = size_a[a[0]], size_b[b[0]]
        while True:  # the side that is behind takes its next token, until both end together
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
                continue
            if end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
                continue
            links.append(a[i] << self.shift | b[j])
            i, j = i + 1, j + 1
            if i - at_a == 1 == j - at_b:
                groups.append(f"{a[at_a]}|{b[at_b]}")
            else:
                groups.append(f"{','.join(map(str, a[at_a:i]))}|{','.join(map(str, b[at_b:j]))}")
            if i == len(a):
                break
            at_a, at_b = i, j
            end_a += size_a[a[i]]
            end_b += size_b[b[j]]
        return len(a), len(b), len(groups), ";".join(groups), struct.pack(f"<{len(links)}{self.kind.char}", *links)

    def learn(self, pieces: set[str]) -> None:
        """Aligns the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.kept]
        self.kept.update({p: self.older[p] for p in new if p in self.older})
        new = [p for p in new if p not in self.kept]
        both = zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self.encode_b(new))
        self.kept.update({p: self.aligned(p.encode(), a.ids, b) for p, a, b in both})

    def align(self, batch: list[str | None]) -> list[Aligned]:
        """Of each text its tokens, groups and links; none where there is no text or the bytes differ."""
        split = [(CUT.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in batch]
        self.learn({p for pieces in split for p in pieces})
        done = []
        for text, pieces in zip(batch, split):
            held = list(map(self.kept.__getitem__, pieces))
            if None in held:  # as a whole the bytes may be right nevertheless
                whole = " " + (text or "")
                held = [self.aligned(whole.encode(), self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(text))]
            if not held or held[0] is None:
                done.append((0, 0, 0, "", b""))
                continue
            a, b, groups, shown, links = zip(*held)
            done.append((sum(a), sum(b), sum(groups), ";".join(shown), b"".join(links)))
        if len(self.kept) > KEPT:
            self.older = {p: x for p, x in self.kept.items() if len(p) <= KEPT_CHARS}
            self.kept = {}
        return done


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of files."""
    return Aligner(path_a, path_b)


LINKED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, link long, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def linked(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """The columns of ``LINKED``: a row by document, and of each task rows of ``link, n`` with how often it has found a link; written."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("groups", pa.string()), ("links", pa.binary()), ("link", pa.int64()), ("n", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        regular, irregular = np.zeros(len(both.bytes_a), np.int64), np.zeros(len(both.pairs), np.int64)
        for batch in batches:
            at = 0
            for some in by_size(texts(batch), AT_ONCE):
                n_a, n_b, groups, shown, links = zip(*both.align(some))
                every = np.frombuffer(b"".join(links), both.kind)
                a, b = every >> both.shift, every & ((1 << both.shift) - 1)
                exact = both.same[a] == b
                regular += np.bincount(a[exact], minlength=len(regular))
                irregular += np.bincount(np.searchsorted(both.pairs, every[~exact]), minlength=len(irregular))
                if digest:
                    shown = [s and sha256(s.encode()).hexdigest() for s in shown]
                columns = [batch.column("doc_id").slice(at, len(some)), *map(pa.array, (n_a, n_b, groups, shown, links))]
                columns += [pa.nulls(len(some), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema)], schema=schema)
                at += len(some)
        (one,), (two,) = np.nonzero(regular), np.nonzero(irregular)
        link = np.concatenate([one << both.shift | both.same[one], both.pairs[two].astype(np.int64)])
        nothing = [pa.nulls(len(link), t) for t in schema.types[:6]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(link), pa.array(np.concatenate([regular[one], irregular[two]]))], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return written(rows.mapInArrow(run, LINKED))


def align_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every whole text.

    A blank and the text are encoded by the tokenizers library's file ``path_a``, the text by the
    sentencepiece model ``path_b``, without special tokens; the files must lie at the same places on
    all machines. ``groups`` has the ids as ``a1,a2|b1;a3|b2,b3``, with ``digest`` its SHA-256 in lower
    case, since it is longer than the text. A link's count is how many links of all documents are of
    the same two tokens; ``count_sum`` is their sum over the document's links, ``n_best`` how many of
    them have the highest count of their token of B.

    A null or empty text, or one whose tokens don't give its bytes on either side, has no tokens:
    zeros, and empty ``groups``. Very long texts are aligned whole. Repeated rows count and are
    returned each; an empty table gives an empty one; other columns are not looked at.
    """
    rows = linked(docs, path_a, path_b, digest)
    sums = rows.where(F.col("link").isNotNull()).groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    both = aligner(path_a, path_b)
    counts = np.zeros(len(both.pairs), np.int64)
    counts[np.searchsorted(both.pairs, sums["link"].to_numpy().astype(both.kind))] = sums["n"].to_numpy()
    token = (both.pairs & ((1 << both.shift) - 1)).astype(np.int64)
    highest = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(highest, token, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[token]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        counts, best = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                links = [np.frombuffer(x.as_py(), both.kind) for x in some.column("links")]
                at = [np.searchsorted(both.pairs, x) for x in links]
                found = [pa.array([f(x) for x in at], pa.int64()) for f in (len, lambda x: int(best[x].sum()), lambda x: int(counts[x].sum()))]
                names = ["doc_id", "n_a", "n_b", "n_groups"]
                columns = [*(some.column(c) for c in names), *found, some.column("groups")]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_links", "n_best", "count_sum", "groups"])

    return rows.where(F.col("link").isNull()).drop("link", "n").mapInArrow(run, RESULT)
