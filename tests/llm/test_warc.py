"""Archives written and read back: contents, segments, revisits, digests."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from tripstrata.llm.tables import Scratch
from tripstrata.llm.warc import chunks, read_chunks, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, record_id string, chunk string"
LONG = "ünï " * 40
ROWS = [
    (1, "http://a/1", LONG),
    (2, "http://a/2", LONG),
    (2, "http://a/2", LONG),
    (0, "http://a/0 b\r\nX: y", "short"),
    (3, None, "short"),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1"),
    (7, "u", "ends with WARC/1.1\r"),
    (8, "u", "x" * 300_000 + "é" * 1000),
    (9, "u", "\r\n\r\n\n\r"),
    (None, "u", LONG),
    (10, "u", "a\x00b c\U0001f389"),
]


def expected(rows):
    first: dict[str, int] = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        later = i is not None and len(raw) >= 100 and i > first[html]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first[html] if later else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [64 << 10, 7])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)
    rows = round_trip(pages, chunk).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(ROWS)
    assert all(r["intact"] for r in rows)
    assert max(r["n_chunks"] for r in rows) > (40_000 if chunk == 7 else 4)


def test_chunks_join_to_the_payload(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "", "") for r in ROWS], SCHEMA)
    write_archives(pages, f"{tmp_path}/w", Scratch(spark, "t"), 50)
    rows = read_chunks(spark, f"{tmp_path}/w").collect()
    joined: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        joined[r["record_id"]] = joined.get(r["record_id"], "") + r["chunk"]
        assert len(r["chunk"].encode()) <= 50
    kept = [html or "" for (i, _, html), e in zip(ROWS, ROWS) if (i, html) != (2, LONG)]
    assert sorted(joined.values()) == sorted([*kept, "", ""])
    raw = b"".join(gzip.open(f).read() for f in tmp_path.glob("w/*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and raw.endswith(b"\r\n\r\n")


def test_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 500, "", "")], SCHEMA)
    write_archives(pages, f"{tmp_path}/w", Scratch(spark, "t"), 100)
    from tripstrata.llm.warc import read_records

    table = read_chunks(spark, f"{tmp_path}/w")
    assert [r["intact"] for r in read_records(table).collect()] == [True]
    assert [r["intact"] for r in read_records(table.filter("chunk_no <> 3")).collect()] == [False]


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slices():
    payload = "aé漢🎉WARC/1.1WARC/1.1".encode()
    for size in (4, 5, 9, 100):
        parts = [bytes(c) for c in chunks(memoryview(payload), size)]
        assert b"".join(parts) == payload and all(len(p) <= size and b"WARC/1.1" not in p for p in parts)
        assert all(p.decode() for p in parts)
