"""WARC archives as a table of chunks.

A payload is written as one record, or, when it is longer than ``CHUNK_BYTES``, as a first segment and
continuation records with segment numbers, so neither writing nor reading back allocates more than a
chunk of it. Reading gives rows of record identifier and chunk number; digests are carried along them
and updated chunk by chunk.

The archives are written and read by Spark's text source, so they can lie in any store. A record ends
with an empty line, and the reader splits at the version line. A payload that holds the version is cut
inside it, so no chunk does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.tables import Batches, Scratch, in_arrow

VERSION = "WARC/1.1"
CRLF = "\r\n"
CHUNK_BYTES = 64 << 10
#: Equal payloads of at least this many bytes are stored once.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_ROWS = 256


def chunks(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Slices of at most ``size`` bytes (at least 4) that end between characters and never hold the
    version line's text. An empty payload is one empty slice."""
    marks = [m.start() + 4 for m in re.finditer(VERSION.encode(), payload)]
    at = 0
    while at < len(payload):
        stop = min(at + size, len(payload))
        while stop < len(payload) and payload[stop] & 0xC0 == 0x80:
            stop -= 1
        while marks and marks[0] <= at:
            marks.pop(0)
        if marks and marks[0] < stop:
            stop = marks[0]
        yield payload[at:stop]
        at = stop
    if not len(payload):
        yield payload


def _header(fields: list[tuple[str, object]]) -> str:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None)]
    return CRLF.join(lines) + CRLF + CRLF


def record_lines(pages: DataFrame, chunk: int, salt: str) -> DataFrame:
    """``(value)``: every record of the archive, a continuation right after what it continues.

    ``pages`` has ``page_id, url, html, payload_bytes, payload_digest, refers_to``.
    """

    def run(batches: Batches) -> Batches:
        task, number, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            names = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                html = names["html"][row]
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                page, refers = names["page_id"][row].as_py(), names["refers_to"][row].as_py()
                url = names["url"][row].as_py()
                first = hashlib.md5(f"{salt}-{task}-{number}".encode()).hexdigest()
                number += 1
                common = [
                    ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else None),
                    ("WARC-Date", DATE),
                    ("Page-Id", page),
                    ("Payload-Length", names["payload_bytes"][row].as_py()),
                    ("WARC-Payload-Digest", f"sha256:{names['payload_digest'][row].as_py()}"),
                ]
                if refers is not None:
                    head = [("WARC-Type", "revisit"), ("WARC-Record-ID", first), ("Refers-To-Page", refers)]
                    held.append(_header([*head, *common, ("Content-Length", 0)]) + CRLF)
                else:
                    parts = list(chunks(payload, chunk))
                    for place, part in enumerate(parts, 1):
                        if place == 1:
                            head = [("WARC-Type", "response"), ("WARC-Record-ID", first)]
                        else:
                            own = hashlib.md5(f"{first}-{place}".encode()).hexdigest()
                            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", first)]
                        segment = [("WARC-Segment-Number", place)] if len(parts) > 1 else []
                        total = [("WARC-Segment-Total-Length", len(payload))] if 1 < place == len(parts) else []
                        shared = common if place == 1 else []
                        fields = [*head, *shared, *segment, *total, ("Content-Length", len(part))]
                        held.append(_header(fields) + str(part, "utf-8") + CRLF)
                        if len(held) >= _ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                            held = []
                if len(held) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    names = ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    return in_arrow(pages.select(*names), run, "value string")


def with_digest(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long"),
        "url",
        "html",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )


def revisits(digests: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, payload_digest, refers_to)`` of the pages whose payload a smaller id has too."""
    large = digests.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    shared = first.filter("refers_to < last").drop("last")
    later = large.select("page_id", "payload_digest").join(shared, "payload_digest").filter("page_id > refers_to")
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, scratch: Scratch, chunk: int = CHUNK_BYTES) -> None:
    """Archives (``.gz``) of ``pages (page_id, url, html)`` below ``path``, a file for each task."""
    full = with_digest(pages)
    # Stored, so its size is known: it is broadcast if small, else both sides are shuffled.
    later = scratch.store(revisits(full.drop("url", "html")))
    joined = full.join(later, ["page_id", "payload_digest"], "left")
    lines = record_lines(joined, chunk, scratch.base.rpartition("-")[2])
    lines.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, chunk_no, record_type, page_id, refers_to, declared_bytes, declared_digest, url,
    chunk)``: one row a record; fields of the whole payload stand in its first chunk only."""
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).filter(F.col("value") != "")
    head = F.substring_index("value", CRLF + CRLF, 1)
    rest = F.expr(f"substring(value, length(head) + {2 * len(CRLF) + 1}, length(value) - length(head) - {4 * len(CRLF)})")
    parsed = raw.withColumn("head", head).withColumn("chunk", rest)

    def field(name: str) -> Column:
        found = F.regexp_extract("head", f"(?m)^{name}: ([^\\r\\n]*)", 1)
        return F.when(found != "", found)

    kind, own = field("WARC-Type"), field("WARC-Record-ID")
    return parsed.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), own).alias("record_id"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk_no"),
        F.when(kind != "continuation", kind).alias("record_type"),
        field("Page-Id").cast("long").alias("page_id"),
        field("Refers-To-Page").cast("long").alias("refers_to"),
        field("Payload-Length").cast("long").alias("declared_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("declared_digest"),
        field("WARC-Target-URI").alias("url"),
        "chunk",
    )


RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "n_chunks int, intact boolean"
)


def read_records(table: DataFrame) -> DataFrame:
    """One row for each record of a chunk table: length and digest of the payload, taken chunk by
    chunk in order (for a revisit: as declared), and whether they are what the record declares."""

    def run(batches: Batches) -> Batches:
        state: dict = {}

        def finished() -> list[dict]:
            if not state:
                return []
            first, revisit = state["first"], state["first"]["record_type"] == "revisit"
            size = first["declared_bytes"] if revisit else state["size"]
            digest = first["declared_digest"] if revisit else state["digest"].hexdigest()
            gapless = first["chunk_no"] == 1
            return [
                {
                    "page_id": first["page_id"],
                    "payload_bytes": size,
                    "payload_digest": digest,
                    "record_type": first["record_type"],
                    "refers_to": first["refers_to"],
                    "n_chunks": state["count"],
                    "intact": gapless and size == first["declared_bytes"] and digest == first["declared_digest"],
                }
            ]

        kinds = pa.schema(
            [
                ("page_id", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("n_chunks", pa.int32()),
                ("intact", pa.bool_()),
            ]
        )
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                record = batch.column("record_id")[row].as_py()
                if record != state.get("record"):
                    out += finished()
                    names = ("chunk_no", "record_type", "page_id", "refers_to", "declared_bytes", "declared_digest")
                    first = {name: batch.column(name)[row].as_py() for name in names}
                    state.clear()
                    state.update(record=record, first=first, size=0, count=0, digest=hashlib.sha256())
                part = batch.column("chunk")[row].as_buffer()
                state["digest"].update(part)
                state["size"] += part.size
                state["count"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if last := finished():
            yield pa.RecordBatch.from_pylist(last, kinds)

    # Chunks of one record are hashed in order by one task, which holds one chunk of them at a time.
    together = table.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return in_arrow(together.drop("url"), run, RECORDS)


def round_trip(pages: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The records of ``pages (page_id, url, html, ...)`` after writing and reading the archives.

    One row for each row of ``pages``. A null payload is empty. Of equal payloads of at least
    ``MIN_REVISIT_BYTES`` the one with the smallest id is the response and the others revisit it; rows
    that share that smallest id are all responses, and so are rows without an id. Control characters
    of an address are percent-encoded; a null address is left out. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path()
    write_archives(pages, path, scratch, chunk)
    return read_records(read_chunks(pages.sparkSession, path))
