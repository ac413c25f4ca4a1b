"""The audit against a walk through every order, document by document."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tripstrata.llm import filter_audit
from tripstrata.llm.filter_audit import RadixTrie, audit, local_minima, with_prefix
from tripstrata.llm.tables import Scratch, ship

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(rows, labels):
    """``rows`` are (doc_id, text, lang)."""
    docs = [(i, t or "", lang or "") for i, t, lang in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = []
    for i, text, part in docs:
        failed = fails(text)
        failed["E"] = i is not None and any(j is not None and j < i and other == text for j, other, _ in docs)
        known.append((i, part, {k for k, v in failed.items() if v}))
    out = []
    for part in {p for _, p, _ in known}:
        own = [(i, f) for i, p, f in known if p == part]
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                failing = sum(letter in f for _, f in own)
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                only = sum(f == {letter} for _, f in own)
                bad = sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                steps.append(("".join(order), step, letter, len(left), len(gone), failing - len(gone), only, *bad))
        out += [(part, order, step, *numbers, shapley[letter]) for order, step, letter, *numbers in steps]
    return sorted(out)


def answer(df):
    return sorted(tuple(row[c] for c in COLUMNS) for row in df.collect())


LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, None, "en"),
    (2, "", None),
    (3, LONG, "en"),
    (4, LONG, "de"),
    (4, LONG, "en"),
    (9, LONG, ""),
    (None, LONG, "en"),
    (None, None, None),
    (5, "Costs $5 " * 300, "en"),
    (6, "UPPER CASE", "de"),
    (6, "UPPER CASE", "de"),
    (7, "UPPER CASE" + "x" * 200_000, "de"),
    (8, "UPPER CASE" + "x" * 200_000, "fr"),
    (0, "UPPER CASE" + "x" * 200_000 + "ü漢", "fr"),
    (10, " \t\r\n\x0b\x0c  ", "en"),
    (11, "a\x1c\x85b " * 220, "en"),
    (-3, LONG, "en"),
]
LABELS = [(3, 1, 0), (4, 1, 1), (4, 0, 0), (9, None, None), (6, 0, 1), (None, 1, 1), (77, 1, 1)]


def tables(spark, rows, labels):
    full = [(i, t, lang, "src", 7, "clash") for i, t, lang in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, mask int, prefix string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("block, prefix", [(filter_audit.BLOCK_BYTES, filter_audit.PREFIX_BYTES), (1, 1), (5_000, 600)])
def test_edge_rows_against_walk(spark, block, prefix):
    ship(spark)
    got = audit(*tables(spark, ROWS, LABELS), block_bytes=block, prefix_bytes=prefix)
    assert answer(got) == brute(ROWS, LABELS)


def test_empty_tables(spark):
    ship(spark)
    assert audit(*tables(spark, [], LABELS)).collect() == []
    assert answer(audit(*tables(spark, ROWS[:5], []))) == brute(ROWS[:5], [])


def test_hot_copies_cross_the_network_once_a_block(spark):
    """5,000 copies of one text: their ids fold into few rows with text, and counts stay whole."""
    ship(spark)
    rows = [(i, LONG, "en") for i in range(5_000)] + [(i, LONG + "!", "en") for i in range(5_000, 5_010)]
    docs, labels = tables(spark, rows, [(4_999, 1, 1)])
    shipped = local_minima(docs.repartition(4), "text", "doc_id", "lang").filter("text IS NOT NULL").count()
    assert shipped <= 2 * 4
    first = [r for r in answer(audit(docs, labels)) if r[1] == "EABCD" and r[2] == 1]
    assert first == [("en", "EABCD", 1, 2, 5_008, 0, 5_008, 1, 1, 120 * 5_008)]


def test_prefixes_keep_equal_texts_together_and_split_the_rest(spark):
    texts = ["same beginning of all " * 4 + str(i % 50) for i in range(500)]
    df = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    found = with_prefix(df, Scratch(spark, "prefix-test"), limit=3_000).collect()
    assert len(found) == 500
    by_text = {}
    for row in found:
        assert bytes(row["text"]).startswith(bytes(row["prefix"]))
        assert by_text.setdefault(bytes(row["text"]), bytes(row["prefix"])) == bytes(row["prefix"])
    assert len(set(by_text.values())) > 1


def test_trie_holds_smallest_ids():
    rng = random.Random(5)
    trie, smallest = RadixTrie(), {}
    for _ in range(3_000):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode()
        doc_id = rng.randrange(1_000)
        list(trie.insert(text, doc_id, "", 0, 1))
        smallest[text] = min(doc_id, smallest.get(text, doc_id))
    found = [(text, end.smallest) for text, end in trie.terminals()]
    assert found == sorted(smallest.items())
