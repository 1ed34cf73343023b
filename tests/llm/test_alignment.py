"""Alignment of two tokenizers against whole encodings and plain Python."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from cases import documents, no_documents, sorted_rows
from check import TESTDATA
from tokenizers import Tokenizer

from fieldtally.llm import alignment
from fieldtally.llm.bpe import byte_alphabet
from fieldtally.llm.common import table
from fieldtally.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def token_bytes(a, b):
    shown = {c: i for i, c in enumerate(byte_alphabet())}
    of_a = {i: bytes(shown[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    of_b = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        of_b[i] = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return of_a, of_b


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_a, of_b = token_bytes(a, b)
    found, counts = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        same = b"".join(of_a[i] for i in ids_a) == b"".join(of_b[i] for i in ids_b) == whole.encode()
        if not text or not same:
            found.append((doc_id, [], [], [], []))
            continue
        ends = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, by_end = 0, {}
            for place, i in enumerate(ids):
                at += len(of[i])
                by_end[at] = place
            ends.append(by_end)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        counts.update(links)
        found.append((doc_id, ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (d, len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), ";".join(g))
        for d, x, y, g, k in found
    ]


ODD = [
    "plain words", "two  blanks   three", " before", "after ", "after  ", "\nline\n\nline \n", "tab\tand\r\nreturn", "a\x1cb c\x85d e",
    "▁ in a text", "x▁y", "<s> </s> <unk> <|endoftext|>", "<0x41> A", "日本語の文 と ことば", "é ß \U0001f44d ﻿", "a b 　c",
    "'s don't 'LL we've", "12345 67 8,9", "...!?  --", " ", "  ", "\n", "\0 nul", "x" * 70_000, "ab " * 30_000, "́ accent", "ﬁ ligature Ａ",
]


@pytest.mark.parametrize("cuts", [True, False])
def test_texts(cuts):
    both = alignment.Aligner(A, B)
    assert both.cuts
    both.cuts = cuts
    given = list(enumerate(ODD))
    for (_, n_a, n_b, n_groups, *_, groups), found in zip(brute(given), both.align(ODD)):
        assert found[:4] == (n_a, n_b, n_groups, groups)


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    both = alignment.Aligner(A, B)
    for _ in range(3):
        for text in ODD[:12]:
            assert both.align([text]) == alignment.aligner(A, B).align([text])
    assert len(both.kept) <= 20


def test_every_link_is_a_known_pair():
    both = alignment.aligner(A, B)
    assert len(both.pairs) < sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b))
    one = both.same[both.same >= 0]
    assert (one < len(both.bytes_b)).all() and len(one) > 5000


def test_query(spark):
    folder = str(TESTDATA / "sf0.001")
    found = QUERIES["op11_token_alignment"](spark, folder)
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    expected = [(*r[:7], r[7] and sha256(r[7].encode()).hexdigest()) for r in brute(rows)]
    assert sorted_rows(found, *COLUMNS[:7], "groups_sha256") == sorted(expected, key=repr)


def test_edges(spark):
    docs = documents(spark).repartition(3)
    found = alignment.align_documents(docs, A, B)
    assert found.columns == list(COLUMNS)
    assert sorted_rows(found, *COLUMNS) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert alignment.align_documents(no_documents(spark), A, B).count() == 0
