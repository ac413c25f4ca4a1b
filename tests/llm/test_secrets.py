"""Candidates and features by brute force, and the forest on findings it has not seen."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tripstrata.llm import queries, secret_forest as secrets
from tripstrata.llm.tables import Scratch


def plain_findings(rows):
    out = []
    for i, t in rows:
        for n, word in enumerate(re.split(r"[\x20\x09-\x0D]+", t) if t is not None else []):
            if found := re.search(r"[A-Za-z0-9_+/=.-]{16,}", word):
                out.append((i, n, found[0]))
    return sorted(out, key=str)


EDGE = [
    (0, None),
    (1, ""),
    (2, 'token = "0123456789abcdef0123456789abcdef"'),
    (2, 'token = "0123456789abcdef0123456789abcdef"'),
    (None, "x" * 100_000),
    (3, "short words only"),
    (4, "averyveryverylongword,alsothisverylongword next"),
    (5, "ü" * 40),
]


def test_findings_equal_scan(spark, small, texts, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df, rows in ((docs, texts), (documents(EDGE), EDGE)):
        got = [(r["doc_id"], r["word_no"], r["candidate"]) for r in secrets.findings(df).collect()]
        assert sorted(got, key=str) == plain_findings(rows)


def test_features(spark, documents):
    docs = documents([(0, 'say token = "ab12AB_cdefthecat99" after'), *[(i, "the cat") for i in range(1, 30)]])
    rows = secrets.findings(docs).withColumn("finding", F.monotonically_increasing_id())
    known = secrets.dictionary(documents([(i, "the cdefthecat") for i in range(30)]))
    (r,) = secrets.described(rows, known).collect()
    n = len("ab12AB_cdefthecat99")
    assert r["f_length"] == n and r["f_digits"] == pytest.approx(4 / n) and r["f_upper"] == pytest.approx(2 / n)
    assert r["f_symbols"] == pytest.approx(1 / n) and r["f_class_changes"] == pytest.approx(5 / n)
    assert r["f_dictionary"] == pytest.approx(10 / n)
    assert (r["f_keyword"], r["f_assigned"], r["f_quoted"], r["f_next"]) == (1, 1, 1, 5)


def test_unseen_findings(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    scratch = Scratch(spark, "t")
    rows = scratch.store(secrets.findings(docs).withColumn("finding", F.monotonically_increasing_id()))
    full = secrets.rule_labels(rows)
    seen = full.filter("pmod(xxhash64(candidate), 2) = 0").select("candidate", "label").distinct()
    unseen = full.filter("pmod(xxhash64(candidate), 2) = 1").select("doc_id", "word_no", "label")
    judged = secrets.scan(docs, seen).join(unseen, ["doc_id", "word_no"])
    table = {(r["label"], r["is_secret"]): r["count"] for r in judged.groupBy("label", "is_secret").count().collect()}
    assert table.get((1.0, True), 0) > 0
    wrong = table.get((1.0, False), 0) + table.get((0.0, True), 0)
    assert wrong <= 0.02 * sum(table.values())


def test_edge_tables(documents):
    rows = secrets.scan(documents(EDGE)).collect()
    assert len(rows) == len(plain_findings(EDGE))
    assert secrets.scan(documents([])).collect() == []


def test_query(spark, medium):
    df = queries.op7_secret_scans(spark, medium)
    texts = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    assert not [word for word in ("Python", "Arrow", "Pandas") if word in plan(df)]
    rows = df.collect()
    assert len(rows) == len(plain_findings(texts))
    tokens = {i for i, t in texts if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    assert tokens and {r["doc_id"] for r in rows if r["is_secret"]} == tokens
