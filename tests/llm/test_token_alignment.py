"""Groups, links and counts against a plain overlap of byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tripstrata.llm import queries, token_alignment
from tripstrata.llm.tables import ship
from tripstrata.llm.token_alignment import align, align_documents, byte_level, pieces

PATHS = public_tokenizers.path(queries.VOCABULARY_A), public_tokenizers.path(queries.VOCABULARY_B)

EDGE = [
    None,
    "",
    " ",
    "\n\n\t \r\n",
    "I'm sure: it'll cost 12,345.67 € | ünïcödé 漢字 🎉🎉  end   ",
    "<|endoftext|> <s> <unk> <0x41> are ordinary",
    "a▁b loses its bytes",
    "x" * 3_000,
    "word and word again " * 200,
    "漢字" * 300,
    "a\x00b​c d",
    "same text",
    "same text",
]


def spans_of(ids, names):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(names(i))))
        at += len(names(i))
    return out


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        decoded = byte_level(PATHS[0]).token_bytes
        self.bytes_a = lambda i: decoded[i]

    def bytes_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def links(self, text):
        """Groups as text, and all pairs of overlapping tokens by trying every pair nearby."""
        if not text:
            return 0, 0, "", []
        a = spans_of(self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a)
        b = spans_of(self.b.encode(text), self.bytes_b)
        whole = (" " + text).encode()
        if b"".join(self.bytes_a(i) for i, *_ in a) != whole or b"".join(self.bytes_b(i) for i, *_ in b) != whole:
            return 0, 0, "", []
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in cuts:
            own = [",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)]
            groups.append("|".join(own))
            low = high
        pairs = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        return len(a), len(b), ";".join(groups), pairs


def expected(rows):
    plain = Plain()
    found = {text: plain.links(text) for text in {t for _, t in rows}}
    counts = Counter(pair for _, text in rows for pair in found[text][3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, text in rows:
        n_a, n_b, groups, pairs = found[text]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[1]] for p in pairs)
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((doc_id, n_a, n_b, n_groups, len(pairs), n_best, sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str), counts


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def answer(df):
    return sorted((tuple(row[f] for f in FIELDS) for row in df.collect()), key=str)


@pytest.mark.parametrize("segment, piece", [(8 << 20, 256 << 10), (64, 100)])
def test_edge_texts(spark, documents, monkeypatch, segment, piece):
    ship(spark)
    monkeypatch.setattr(token_alignment, "PIECE_BYTES", piece)
    rows = [*enumerate(EDGE), (None, "no id"), (3, "twice"), (3, "twice")]
    docs, pairs = align_documents(documents(rows), *PATHS, segment_bytes=segment)
    want, counts = expected(rows)
    assert answer(docs) == want
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == counts


def test_no_rows_and_no_tokens(spark, documents):
    ship(spark)
    assert align_documents(documents([]), *PATHS)[0].collect() == []
    assert answer(align_documents(documents([None, ""]), *PATHS)[0]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_long_texts_in_pieces_give_the_same_ids(monkeypatch):
    text = "Some words, it's 'quoted' and 12 apples\n\n  more text here " * 50
    whole = byte_level(PATHS[0]).encode(text)
    monkeypatch.setattr(token_alignment, "PIECE_BYTES", 30)
    assert byte_level(PATHS[0]).encode(text) == whole


def test_one_long_group():
    """No common end before the last: links grow with the tokens, not with their product."""
    one = align("あ" * 5_000, byte_level(PATHS[0]), pieces(PATHS[1]))
    assert len(one.links) <= len(one.a) + len(one.b)


def test_query(spark, small, texts):
    got = answer(queries.QUERIES["op12_cross_tokenizer_alignment"](spark, small))
    plain = [(i, t) for i, t in texts]
    short = [(i, t) for i, t in plain if len(t or "") < 1_500]
    # Sizes and groups of the shorter texts by trying all pairs; counts over all by the aligner's own links.
    want, _ = expected(short)
    own = {row[0]: row for row in got}
    assert len(got) == len(plain)
    for row in want:
        assert own[row[0]][:5] == row[:5] and own[row[0]][7] == row[7]
    left, right = byte_level(PATHS[0]), pieces(PATHS[1])
    links = {i: align(t, left, right).links for i, t in plain}
    counts = Counter(link for each in links.values() for link in each)
    top = Counter()
    for link, n in counts.items():
        top[link & 0xFFFFFFFF] = max(top[link & 0xFFFFFFFF], n)
    for i, each in links.items():
        assert own[i][5] == sum(counts[x] == top[x & 0xFFFFFFFF] for x in each)
        assert own[i][6] == sum(counts[x] for x in each)
