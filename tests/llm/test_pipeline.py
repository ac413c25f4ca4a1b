"""Every stage on its own input against what its operator decides, and the whole against the stages."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tests.llm.test_byte_bpe import expected
from tests.llm.test_phrase_index import plain as plain_matches
from tests.llm.test_simhash import plain_components
from tripstrata.llm import fuzzy_lines, quality_rules


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The input and the output of each stage."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
        seen[name] = (docs, out)
        docs = out
    return seen


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_columns_are_kept(stages):
    for name, (docs, out) in list(stages.items())[:-1]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_quality(spark, small, stages):
    docs, out = stages["quality_rules"]
    kept = quality_rules.assess(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("kept")
    ids = {r["doc_id"] for r in kept.collect()}
    assert rows(out) == [r for r in rows(docs) if r[0] in ids] and len(ids) > 0.7 * docs.count()


def test_lines(stages):
    docs, out = stages["line_dedup"]
    removed = {r["doc_id"]: set(map(int, filter(None, r["removed"].split(",")))) for r in fuzzy_lines.find_repeated(docs).collect()}
    expected_texts = {}
    for doc_id, text in rows(docs, "doc_id", "text"):
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in removed[doc_id])
        if kept.strip():
            expected_texts[doc_id] = kept
    assert dict(rows(out, "doc_id", "text")) == expected_texts
    assert all(n == len(t) for t, n in rows(out, "text", "n_chars"))


def test_near_duplicates(stages):
    docs, out = stages["simhash_near_dedup"]
    first = {i for i, _, root in plain_components(rows(docs, "doc_id", "text")) if i == root}
    assert rows(out) == [r for r in rows(docs) if r[0] in first]


def test_contamination(spark, small, stages):
    docs, out = stages["benchmark_decontamination"]
    items = rows(spark.read.parquet(f"{small}/benchmark.parquet"), "item_id", "text")
    # A window can only occur where its first word does; the scan goes over documents that share some.
    first_words = {re.findall(r"\w+", t.lower())[0] for _, t in items if t and re.findall(r"\w+", t.lower())}
    texts = [(i, t) for i, t in rows(docs, "doc_id", "text") if first_words]
    clean = {i for i, _, hit, _, _ in plain_matches(texts, items) if hit == 0}
    assert rows(out) == [r for r in rows(docs) if r[0] in clean]


def test_tokens(stages):
    docs, out = stages["byte_level_bpe"]
    got = sorted(((r["doc_id"], list(r["token_ids"])) for r in out.collect()), key=str)
    assert got == sorted(((i, ids) for i, ids, _ in expected(rows(docs, "doc_id", "text"))), key=str)
    assert all(r["intact"] and r["n_tokens"] == len(r["token_ids"]) for r in out.collect())


def test_whole_equals_stages(spark, small, stages):
    got = rows(corpus_pipeline.run(spark, small), "doc_id", "n_tokens", "token_ids")
    assert got == rows(stages["byte_level_bpe"][1], "doc_id", "n_tokens", "token_ids")
