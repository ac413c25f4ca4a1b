"""Ids as the library gives them for the whole text, and exact round trips."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

from tripstrata.llm import byte_bpe, queries
from tripstrata.llm.byte_bpe import encode_decode, encoding

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN

EDGE = [
    None,
    "",
    " ",
    "\n\n  \t",
    "I'm sure they've said: it'll cost 12,345.67 € | ünïcödé 漢字 🎉🎉  end   ",
    "<|endoftext|> is ordinary text",
    "x" * 100_000,
    "word " * 50_000,
    "a\x00b​c d",
    "same text",
    "same text",
]


def answer(df):
    return sorted(((r["doc_id"], list(r["token_ids"]), bytes(r["decoded"])) for r in df.collect()), key=str)


def expected(rows):
    encoder = encoding(PATH, PATTERN)
    return sorted(((i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)


@pytest.mark.parametrize("segment", [8 << 20, 100])
def test_edge_texts(documents, monkeypatch, segment):
    monkeypatch.setattr(byte_bpe, "SEGMENT_BYTES", segment)
    rows = [*enumerate(EDGE), (None, "no id"), (3, "twice"), (3, "twice")]
    assert answer(encode_decode(documents(rows), PATH, PATTERN)) == expected(rows)


def test_no_rows_and_no_words(documents):
    assert encode_decode(documents([]), PATH, PATTERN).collect() == []
    assert answer(encode_decode(documents([None, ""]), PATH, PATTERN)) == [(0, [], b""), (1, [], b"")]


def test_query(spark, small, texts):
    encoder = encoding(PATH, PATTERN)

    def row(doc_id, text):
        ids = encoder.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        return doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()

    got = sorted(tuple(r) for r in queries.QUERIES["op3_byte_level_bpe"](spark, small).collect())
    assert got == sorted(row(*pair) for pair in texts)
