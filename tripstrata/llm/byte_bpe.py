"""Byte-level BPE over a corpus: every distinct word is encoded once.

Texts are cut into pre-tokens. A segment of documents sends each of its distinct pre-tokens once, in
packed rows, to the bucket of the pre-token's hash; there every distinct pre-token of the corpus is
encoded once, and the ids go back to the segments that asked. The segment's documents come along as
positions: a sequence of numbers into the segment's pre-tokens, so what is shuffled is one number for
each pre-token and one copy of each word for each segment. Decoding joins the ids with the table of
token bytes, which is as large as the vocabulary.

The documents are read twice, once for the words and once for the sequences. A segment's key holds a
digest of its words, so a source that deals its rows differently the second time is an error, not a
wrong answer; store such a source first.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, in_arrow

SEGMENT_BYTES = 8 << 20
#: Buckets of words for each shuffle partition.
BUCKETS_PER_PARTITION = 2


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, in order of their ids, and where each begins."""
    ranks = _ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return np.frombuffer(b"".join(tokens), np.uint8), begin


def _pack(array: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed: the high planes are nearly empty."""
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def gather(values: np.ndarray, begin: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``picked`` one after the other, and the bounds between them."""
    lengths = begin[picked + 1] - begin[picked]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(bounds[-1]) + np.repeat(begin[picked] - bounds[:-1], lengths)
    return values[source], bounds


class Segment:
    """Pre-tokens of one block of documents, ordered by bucket, and each document as a sequence."""

    def __init__(self, texts: list[str | None], pattern: regex.Pattern, buckets: int):
        number: dict[str, int] = defaultdict(count().__next__)
        found = [list(map(number.__getitem__, pattern.findall(text))) if text else [] for text in texts]
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        encoded = [word.encode() for word in number]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        lengths = np.array([len(word) for word in encoded], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        hashes = spans.xxh64(raw, begin[:-1], lengths)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.sequence = place[np.concatenate([np.array(f, dtype=np.int64) for f in found] or [np.zeros(0, np.int64)])]
        self.bucket = bucket[order]
        self.lengths = lengths[order]
        self.raw, self.begin = gather(raw, begin, order)
        self.digest = xxhash.xxh64_hexdigest(self.raw.tobytes() + self.lengths.tobytes())


def _segments(batches: Batches, pattern: str, buckets: int, limit: int) -> Iterator[tuple[str, Segment, pa.RecordBatch]]:
    compiled = regex.compile(pattern)
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for block in spans.blocks(batch.column("text"), limit):
            rows = batch.slice(block.lo, block.rows)
            segment = Segment(rows.column("text").to_pylist(), compiled, buckets)
            yield f"{task}-{number}-{segment.digest}", segment, rows
            number += 1


def word_rows(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """``(segment, bucket, words)``: the distinct pre-tokens of a segment, packed by bucket."""

    def run(batches: Batches) -> Batches:
        for key, segment, _ in _segments(batches, pattern, buckets, SEGMENT_BYTES):
            cuts = np.flatnonzero(np.diff(segment.bucket, prepend=-1))
            stops = np.append(cuts[1:], len(segment.bucket))
            packed = []
            for lo, hi in zip(cuts.tolist(), stops.tolist()):
                head = np.concatenate([[hi - lo], segment.lengths[lo:hi]]).astype("<u4")
                packed.append(zstandard.compress(head.tobytes() + segment.raw[segment.begin[lo] : segment.begin[hi]].tobytes(), 3))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(cuts)), pa.array(segment.bucket[cuts]), pa.array(packed, pa.binary())],
                ["segment", "bucket", "words"],
            )

    return in_arrow(docs.select("text"), run, "segment string, bucket long, words binary")


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(segment, bucket, sizes, ids)`` for packed words that stand together by bucket. A task holds
    the distinct words of one bucket at a time and encodes each once."""

    def run(batches: Batches) -> Batches:
        encoder = encoding(path, pattern)
        bucket, known = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if (own := batch.column("bucket")[row].as_py()) != bucket:
                    bucket, known = own, {}
                raw = zstandard.decompress(batch.column("words")[row].as_py())
                number = int(np.frombuffer(raw, "<u4", 1)[0])
                ends = (4 + 4 * number + np.cumsum(np.frombuffer(raw, "<u4", number, 4), dtype=np.int64)).tolist()
                at, found = 4 + 4 * number, []
                for end in ends:
                    word = raw[at:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoder.encode_ordinary(word.decode())
                    found.append(ids)
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("segment").slice(row, 1),
                        batch.column("bucket").slice(row, 1),
                        pa.array([_pack(np.array([len(ids) for ids in found]))]),
                        pa.array([_pack(np.array([i for ids in found for i in ids]))]),
                    ],
                    ["segment", "bucket", "sizes", "ids"],
                )

    return in_arrow(words, run, "segment string, bucket long, sizes binary, ids binary")


def encode_decode(docs: DataFrame, path: str, pattern: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*ids, token_ids array<int>, decoded binary)``, one row for each row of ``docs (text, ...)``.

    ``token_ids`` are the ranks that the BPE of the rank file at ``path`` gives each match of
    ``pattern`` by itself, without special tokens; ``decoded`` is the concatenation of their bytes. A
    null text is an empty one, with no ids. Repeated rows are answered one by one; an empty table
    gives no rows. The rank file must be at the same path on every machine.
    """
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.struct(*ids).alias("id"), "text")
    id_type = chosen.schema["id"].dataType.simpleString()

    def sequences(batches: Batches) -> Batches:
        for key, segment, rows in _segments(batches, pattern, buckets, SEGMENT_BYTES):
            offsets = pa.array([0, rows.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key]),
                    pa.ListArray.from_arrays(offsets, rows.column("id")),
                    pa.array([_pack(np.diff(segment.first))]),
                    pa.array([_pack(segment.sequence)]),
                ],
                ["segment", "held", "counts", "sequence"],
            )

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:  # the other way round, a segment without words, is fine
            raise ValueError("the documents were dealt to other segments when they were read again; store them first")
        held = left.column("held").combine_chunks().flatten()
        first = np.concatenate([[0], np.cumsum(_unpack(left.column("counts")[0].as_py()))]).astype(np.int64)
        sequence = _unpack(left.column("sequence")[0].as_py())
        right = right.sort_by("bucket")
        sizes = [_unpack(blob) for blob in right.column("sizes").to_pylist()]
        numbers = [_unpack(blob) for blob in right.column("ids").to_pylist()]
        begin = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
        if len(sequence) and sequence.max() >= len(begin) - 1:
            raise ValueError("words of a segment are missing; store the documents first")
        encoded, bounds = gather(np.concatenate([*numbers, np.zeros(0, np.int64)]), begin, sequence)
        id_bounds = bounds[first]
        table, table_begin = token_bytes(path)
        decoded, byte_bounds = gather(table, table_begin, encoded)
        columns = {
            **{name: held.field(place) for place, name in enumerate(ids)},
            "token_ids": pa.LargeListArray.from_arrays(pa.array(id_bounds), pa.array(encoded.astype(np.int32))).cast(
                pa.list_(pa.int32())
            ),
            "decoded": pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                len(held),
                [None, pa.py_buffer(byte_bounds[id_bounds].astype("<i8")), pa.py_buffer(decoded)],
            ).cast(pa.binary()),
        }
        return pa.table(columns)

    words = word_rows(chosen, pattern, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    encoded = encode_words(words, path, pattern)
    schema = "segment string, held array<" + id_type + ">, counts binary, sequence binary"
    texts = in_arrow(chosen, sequences, schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema["id"].dataType.fields)
    return (
        texts.groupBy("segment")
        .cogroup(encoded.groupBy("segment"))
        .applyInArrow(assemble, f"{fields}, token_ids array<int>, decoded binary")
    )
