"""Phrase and proximity matches against plain scans."""

from __future__ import annotations

import re

import pytest

from tripstrata.llm import phrase_index
from tripstrata.llm.phrase_index import matches

LOWER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, items, width=10, slop=5):
    wins = [(i, tuple(w[k : k + width])) for i, t in items if (w := words(t)) for k in range(max(len(w) - width + 1, 1))]
    out = []
    for doc_id, text in rows:
        own = words(text)
        hit, ids, near = set(), set(), set()
        for item, win in wins:
            for k in range(len(own) - len(win) + 1):
                if tuple(own[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(item)
            reach = len(win) - 1 + slop
            places = [[k for k, w in enumerate(own) if w == term] for term in win]
            near_by = min(places, key=len)
            if any(all(any(abs(q - p) <= reach for q in other) for other in places) for p in near_by):
                near.add(item)
        out.append((doc_id, len(own), len(hit), sorted(i for i in ids if i is not None), near))
    return sorted(out, key=str)


def answer(df):
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], r["items"], set(r["near_items"])) for r in df.collect()), key=str
    )


ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "ALPHA, beta; gamma-delta epsilon zeta ETA theta iota kappa!"),
    (3, "x alpha beta gamma delta epsilon zeta eta theta iota x kappa"),
    (4, None),
    (5, ""),
    (6, "... --- !!!"),
    (None, "short item here"),
    (7, "übung été über naïve short item here short item here"),
    (8, "kappa iota theta eta zeta epsilon delta gamma beta alpha"),
    (9, "alpha " * 30_000 + "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (10, "z" * 200_000),
    (11, "alpha beta gamma delta epsilon"),
    (12, "zeta eta theta iota kappa lambda mu"),
    (13, "one one one one one one one one one one one one"),
]
QUERY = [
    (100, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (101, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (102, "short item here"),
    (103, None),
    (104, "?!"),
    (105, "one " * 11),
    (106, "été über"),
]


@pytest.mark.parametrize("block, segment", [(50_000, 1 << 20), (2, 64)])
def test_equals_scan(spark, documents, monkeypatch, block, segment):
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(phrase_index.window_blocks, "__defaults__", (block,))
    found = matches(documents(ROWS), spark.createDataFrame(QUERY, ITEMS))
    assert answer(found) == plain(ROWS, [q for q in QUERY])


def test_empty_tables(spark, documents):
    assert matches(documents([]), spark.createDataFrame(QUERY, ITEMS)).collect() == []
    none = matches(documents(ROWS[:3]), spark.createDataFrame([], ITEMS)).collect()
    assert [r["n_hit"] for r in none] == [0, 0, 0] and all(r["items"] == [] for r in none)


def test_item_without_id(spark, documents):
    row = matches(documents(["a b c"]), spark.createDataFrame([(None, "b c")], ITEMS)).collect()[0]
    assert (row["n_hit"], row["items"]) == (2, [])
