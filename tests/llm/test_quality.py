"""Counts by their definition, features by brute force, and held-out accuracy of both models."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tripstrata.llm import hashed_text, ordinal_quality, quality_rules, queries, spans

LABELS = "doc_id long, quality int, toxic int"
EDGE = [
    None,
    "",
    " \n \n",
    "a b c a b c a b c",
    "line one\nline one\nline one \n\n\nline one",
    "#*$%&|<> ünïcödé ßß 漢字 | x",
    "w " * 60,
    "x" * 50_000,
    "one two three " * 20_000,
    "\n",
    "a\x00b\x1fc d e",
]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_base_counts_equal_definition(texts):
    rows = [t for _, t in texts] + EDGE
    for limit in (1 << 22, 500):
        got = []
        for block in spans.blocks(pa.array(rows, pa.string()), limit):
            counts, _ = quality_rules.base_counts(block)
            flags = quality_rules.base_failed(counts)
            got += zip(*(counts[name].tolist() for name in quality_rules.STATS), flags.tolist())
        assert got == [(*(c := plain_counts(t)), failed(c)) for t in rows]


def test_score_is_sum_over_features(texts):
    draw = np.random.default_rng(1)
    weights = draw.normal(size=2 * hashed_text.BUCKETS)
    rows = [t for _, t in texts[:40]] + EDGE
    (block,) = spans.blocks(pa.array(rows, pa.string()), 1 << 26)
    kinds = hashed_text.grams_of(block)
    by_features = [weights[i] @ v for i, v in hashed_text.sparse_of(kinds, block.rows)]
    assert np.allclose(hashed_text.scores_of(kinds, weights), by_features)
    alone = []
    for text in rows:
        (one,) = spans.blocks(pa.array([text], pa.string()))
        kinds = hashed_text.grams_of(one)
        assert sum(len(g.buckets) for g in kinds[1]) == sum(max(len(text or "") - n + 1, 0) for n in (3, 5))
        alone.append(hashed_text.scores_of(kinds, weights)[0])
    assert np.allclose(alone, by_features)


def test_minimise_finds_the_minimum():
    scale = np.array([1.0, 10.0, 100.0])

    def loss(x):
        return float(0.5 * scale @ (x - 3) ** 2), scale * (x - 3)

    assert np.allclose(hashed_text.minimise(np.zeros(3), loss), 3, atol=1e-3)


@pytest.fixture(scope="module")
def rated(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    return docs, spark.read.parquet(f"{medium}/labels.parquet")


def test_quality_verdict_on_unseen_labels(rated):
    docs, labels = rated
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = quality_rules.assess(docs, seen).join(unseen, "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    right = [r["kept"] == (r["quality"] == 1) for r in judged]
    assert len(judged) > 100 and np.mean(right) > 0.97
    assert not any(r["kept"] for r in rows if r["base_failed"])
    brier = np.mean([(r["score"] - r["quality"]) ** 2 for r in judged])
    assert brier < 0.05


def test_grades_on_unseen_labels(rated):
    docs, labels = rated
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = ordinal_quality.grade_documents(docs, seen).join(unseen, "doc_id").collect()
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] for r in rows)
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([r["selected"] for r in good]) > 0.9
    for low in ([r for r in rows if r["quality"] == 0], [r for r in rows if r["toxic"] == 1]):
        assert np.mean([r["expected_grade"] for r in good]) > np.mean([r["expected_grade"] for r in low]) + 0.2


def test_thresholds_of_known_grades():
    """Scores in three bands: the refitted thresholds lie between them."""
    draw = np.random.default_rng(2)
    levels = draw.integers(0, 3, 600)
    sample = hashed_text.Sample(
        [np.array([5])] * 600, [np.array([float(level)]) for level in levels], levels, np.full(600, 1 / 600)
    )
    model = ordinal_quality.fit(sample)
    raw = model.weights[5] * np.array([0.0, 1.0, 2.0])
    assert raw[0] < model.thresholds[0] < raw[1] < model.thresholds[1] < raw[2]


def test_sample_is_bounded(spark):
    """Rows that share an id count once; features beyond the bound stay out, each grade keeps some."""
    rows = [(1, f"copy {n} of the same document") for n in range(10_000)]
    rows += [(i, f"word{i} " * 3 + "and some more text") for i in range(2, 40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    whole = hashed_text.labelled_sample(docs, labels, "quality", (0, 1), 100)
    again = hashed_text.labelled_sample(docs.repartition(3), labels, "quality", (0, 1), 100)
    assert len(whole) == 39 and np.array_equal(whole.indices, again.indices) and np.array_equal(whole.values, again.values)
    part = hashed_text.labelled_sample(docs, labels, "quality", (0, 1), 100, max_bytes=8 * 400)
    assert 2 <= len(part) < len(whole) and set(part.labels.tolist()) == {0, 1} and len(part.indices) <= 400
    least = hashed_text.labelled_sample(docs, labels, "quality", (0, 1), 100, max_bytes=1)
    assert len(least) == 2
    assert len(hashed_text.labelled_sample(docs.limit(0), labels, "quality", (0, 1), 100)) == 0


@pytest.mark.parametrize("operator", [quality_rules.assess, ordinal_quality.grade_documents])
def test_edge_tables(spark, documents, operator):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, None), (None, 1, 0), (2, None, 1), (3, 0, 0), (3, 1, 0)], LABELS)
    rows = operator(documents(EDGE + [(None, "x"), (3, "x"), (3, "x")]), labels).collect()
    assert len(rows) == len(EDGE) + 3
    assert operator(documents([]), labels).collect() == []
    assert len(operator(documents(EDGE), spark.createDataFrame([], LABELS)).collect()) == len(EDGE)


def test_kept_rows_are_unchanged(spark, rated):
    docs, labels = rated
    wide = docs.select("n_chars", "text", docs.lang.alias("score"), "doc_id", "source")
    kept = quality_rules.keep_good(wide, labels)
    assert kept.schema == wide.schema
    expected = {r["doc_id"] for r in quality_rules.assess(docs, labels).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_queries_answer_every_document(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert queries.QUERIES["op1_quality_rules"](spark, small).count() == n
    assert queries.QUERIES["op9_quality_classifier"](spark, small).count() == n
