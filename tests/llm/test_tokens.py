"""BPE and token counts against the libraries that own the vocabulary files."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from cases import LONG_TEXT, LONG_WORD, TEXTS, documents, no_documents, sorted_rows
from tokenizers import Tokenizer

from fieldtally.llm import bpe, token_count
from fieldtally.llm.queries import QUERIES

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = "aaabcdeetthhABCé ÉñßΣσς's 'll    \t\n\x00\x1c\x1e\x85\xa0　0123٣½Ⅳ漢字がが!?#$%&{}́ﬁİı﻿▁👍🏽"


def strings(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    found = []
    for i in range(n):
        text = "".join(draw.choice(POOL) for _ in range(draw.randint(0, 40)))
        text += draw.choice(["", "", "<|endoftext|>", "<|ENDOFTEXT|>x", "<s>", "</s> a"])
        if i % 40 == 0:  # long words, beyond what is merged by scanning
            text += draw.choice("abn ") * draw.randint(90, 300) + "".join(draw.choice("abcnte") for _ in range(300))
        found.append(text)
    return found


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_bpe_is_the_librarys(library):
    own, texts = bpe.WordBPE(WORDS), strings(3000, 1)
    for text, (ids, shown) in zip(texts, own.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected
        assert shown == own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_forgets_and_relearns(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own = bpe.WordBPE(WORDS)
    for text in strings(200, 2):
        ids = own.encode([text])[0][0]
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_decodes_the_packed_ids(monkeypatch):
    own = bpe.WordBPE(WORDS)
    monkeypatch.setattr(own, "decode", lambda ids: f"{len(ids) // 4} ids")
    assert all(shown == f"{len(ids) // 4} ids" for ids, shown in own.encode(strings(50, 3)))


def test_bpe_edges(spark, library):
    found = bpe.encode_documents(documents(spark), WORDS).collect()
    assert len(found) == len(TEXTS) + 3
    for row in found:
        if row.doc_id is not None:
            expected = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
            assert row.n_tokens == len(expected) and bytes(row.ids) == struct.pack(f"<{len(expected)}I", *expected)
    assert bpe.encode_documents(no_documents(spark), WORDS).count() == 0


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in QUERIES["op5_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts_are_the_librarys(pieces):
    own = token_count.Transducer(PIECES)
    draw, vocabulary = random.Random(3), sorted(own.score)
    texts = strings(2000, 4) + ["".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 7))) for _ in range(2000)]
    for text in [*texts, LONG_WORD, LONG_TEXT]:
        assert own.count(text) == len(pieces.encode(text))


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_chunks_compose(pieces, monkeypatch, size):
    monkeypatch.setattr(token_count, "CHUNK", size)
    own = token_count.Transducer(PIECES)
    for text in strings(150, size):
        assert own.count(text) == len(pieces.encode(text))


def test_counts_with_few_states(pieces, monkeypatch):
    monkeypatch.setattr(token_count, "STATES", 10)
    own = token_count.Transducer(PIECES)
    assert [own.count(t) for t in strings(100, 5)] == [len(pieces.encode(t)) for t in strings(100, 5)]


def test_count_edges(spark, pieces):
    for row in token_count.count_tokens(documents(spark), PIECES).collect():
        if row.doc_id is not None:
            text = TEXTS[row.doc_id] or ""
            assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(pieces.encode(text)))
    assert token_count.count_tokens(no_documents(spark), PIECES).count() == 0


def test_count_query(spark, pieces):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    expected = sorted((i, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 4096) for i, t in docs.items())
    assert sorted_rows(QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001"), "*") == sorted(expected, key=repr)
