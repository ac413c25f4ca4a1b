"""Curve indices against a walk along the curve, shards against their law."""

from __future__ import annotations

import itertools
import zlib

import pytest

from tripstrata.llm import queries
from tripstrata.llm.hilbert_shards import assign, with_hilbert, write_files
from tests.helpers import plan


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 3), (3, 2), (3, 3)])
def test_curve_visits_neighbours(spark, dims, bits):
    axes = [f"x{i}" for i in range(dims)]
    cells = list(itertools.product(range(2**bits), repeat=dims))
    df = spark.createDataFrame([(*c, *c) for c in cells], ", ".join(f"{a} long" for a in [*axes, *(f"k{a}" for a in axes)]))
    rows = sorted((r["h"], tuple(r[f"k{a}"] for a in axes)) for r in with_hilbert(df, axes, bits, "h").collect())
    assert [h for h, _ in rows] == list(range(2 ** (bits * dims)))
    for (_, a), (_, b) in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def check(rows, texts, shards=40):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(0 <= s < shards for s in slots)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in rows)


def test_query(spark, small, texts):
    df = queries.op5_sharding(spark, small)
    assert "Python" not in plan(df) and "Arrow" not in plan(df)
    check(df.collect(), texts)


def test_edge_rows(spark, documents):
    rows = [(1, None), (1, None), (None, "x"), (2, ""), (3, "y" * 100_000), *((i, "same") for i in range(4, 100))]
    check(assign(documents(rows)).collect(), rows)
    assert assign(documents([])).collect() == []
    nulls = spark.createDataFrame([(1, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    check(assign(nulls).collect(), [(1, "a")])


def test_files_can_be_pruned(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    write_files(docs, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    box = "source = 'src3' AND n_chars < 2000"
    boxes = back.selectExpr("input_file_name() AS f", "source", "n_chars").groupBy("f").agg(
        {"source": "min", "n_chars": "min"}
    )
    files = boxes.count()
    touched = back.filter(box).selectExpr("input_file_name() AS f").distinct().count()
    assert files > 4 and touched <= files // 2
