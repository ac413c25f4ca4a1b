"""Fingerprints and links against a plain rendering of their definition."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tripstrata.llm import queries, simhash_gph
from tripstrata.llm.simhash_gph import allocate, near_duplicates
from tripstrata.llm.tables import Scratch

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(gram.encode(), 42) for gram in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({fp for _, fp in prints})
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    smallest: dict[int, int] = {}
    for i, fp in prints:
        if i is not None:
            smallest[find(fp)] = min(i, smallest.get(find(fp), i))
    return sorted(((i, f"{fp:016x}", smallest.get(find(fp))) for i, fp in prints), key=str)


def answer(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_query_equals_definition(spark, small, texts):
    assert answer(queries.op8_simhash_near_dedup(spark, small)) == plain_components(texts)


def test_edge_rows(documents):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (5, base),
        (5, base),
        (3, base.upper()),
        (None, base),
        (9, None),
        (8, ""),
        (7, " \n\t "),
        (6, "word"),
        (4, "word pair"),
        (2, base + " x"),
        (1, "ab " * 70_000),
        (0, "y" * 100_000),
    ]
    assert answer(near_duplicates(documents(rows))) == plain_components(rows)


def test_empty_table(documents):
    assert near_duplicates(documents([])).collect() == []


def test_close_fingerprints_are_all_linked(spark, tmp_path):
    """Random fingerprints, and dense groups around a few of them."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 300, dtype=np.int64)
    near = [int(base[0]) ^ (1 << int(i)) ^ (1 << int(j)) for i, j in draw.integers(0, 62, (400, 2))]
    values = sorted({int(v) for v in base} | set(near))
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {tuple(r) for r in simhash_gph.links(distinct, Scratch(spark, "t")).collect()}
    expected = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert found == expected and len(expected) > 1000


def test_thresholds_add_up_and_cost_least():
    draw = np.random.default_rng(5)
    for parts in (2, 3, 4):
        costs = np.concatenate([np.zeros((50, parts, 1)), draw.random((50, parts, 3)).cumsum(axis=2)], axis=2)
        levels = allocate(costs, 2)
        assert (levels.sum(axis=1) == 2 - parts + 1).all()
        for row in range(50):
            every = [
                sum(costs[row, i, level] for i, level in enumerate(picked))
                for picked in np.ndindex(*[4] * parts)
                if sum(picked) == 3
            ]
            paid = sum(costs[row, i, t + 1] for i, t in enumerate(levels[row]))
            assert abs(paid - min(every)) < 1e-12
