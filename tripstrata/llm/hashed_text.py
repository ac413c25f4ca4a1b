"""Hashed word and character n-gram features of whole texts, for linear models.

A text's score is a weighted sum over its n-grams: each word n-gram and each character n-gram adds
the weight of its bucket, and each of the two sums is divided by the root of its number of n-grams.
Scoring therefore needs no table of distinct features: it hashes, looks weights up, and adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, Scratch, in_arrow

#: Buckets of each of the two kinds of n-grams.
BITS = 16
BUCKETS = 1 << BITS
WORD_GRAMS = (1, 2)
CHAR_GRAMS = (3, 5)

#: Features of a sample on the driver, in bytes, and the pieces in which they come there.
SAMPLE_BYTES = 128 << 20
_PIECES = 32
#: Matrix entries in one step of a product.
_ENTRIES = 1 << 20

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass
class Grams:
    """Buckets of all n-grams of one kind and size, and where each text's begin."""

    buckets: np.ndarray
    first: np.ndarray


def _windows(values: np.ndarray, first: np.ndarray, size: int, offset: int) -> Grams:
    """Buckets of all runs of ``size`` values inside a text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if size == 1 or not len(values):
        mixed = values * _MIX[0]
    else:
        span = max(len(values) - size + 1, 0)
        mixed = np.full(span, _U(size))
        for place in range(size):
            mixed += values[place : place + span] * _MIX[place]
            mixed ^= mixed >> _U(29)
    inside = np.ones(len(mixed), dtype=bool)
    # The last size - 1 values of each text begin no run of their own.
    for back in range(1, size):
        at = first[1:][np.diff(first) >= back] - back
        inside[at[at < len(inside)]] = False
    buckets = ((mixed[inside] * _MIX[1]) >> _U(64 - BITS)).astype(np.int64) + offset
    return Grams(buckets, starts)


def word_hashes(block: spans.Block) -> tuple[np.ndarray, spans.Words]:
    data = spans.LOWER[block.data]
    found = spans.words(block, data, spans.NOT_BLANK)
    return spans.xxh64(data, found.starts, found.lengths), found


def code_points(block: spans.Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block's texts, A-Z in lower case, and where each text's begin."""
    lower = spans.LOWER[block.data]
    points = np.frombuffer(lower.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.uint64)
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    return points, lead[block.offsets]


def grams_of(block: spans.Block, hashed: tuple[np.ndarray, spans.Words] | None = None) -> tuple[list[Grams], list[Grams]]:
    hashes, found = hashed or word_hashes(block)
    points, first = code_points(block)
    by_word = [_windows(hashes, found.first, size, 0) for size in WORD_GRAMS]
    by_char = [_windows(points, first, size, BUCKETS) for size in CHAR_GRAMS]
    return by_word, by_char


def scores_of(kinds: tuple[list[Grams], list[Grams]], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of each text, without intercept; 0 for a text without n-grams."""
    total = 0.0
    for grams in kinds:
        number = sum(np.diff(g.first) for g in grams)
        summed = sum(spans.per_row(weights[g.buckets], g.first) for g in grams)
        total = total + summed / np.sqrt(np.maximum(number, 1))
    return total


def sparse_of(kinds: tuple[list[Grams], list[Grams]], rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: the same numbers that ``scores_of`` adds up."""
    out = []
    for row in range(rows):
        buckets, values = [], []
        for grams in kinds:
            own = np.concatenate([g.buckets[g.first[row] : g.first[row + 1]] for g in grams])
            distinct, counts = np.unique(own, return_counts=True)
            buckets.append(distinct)
            values.append(counts / np.sqrt(max(len(own), 1)))
        out.append((np.concatenate(buckets), np.concatenate(values)))
    return out


class Sample:
    """Labelled rows as a sparse matrix on the driver; their number is bounded by the caller.

    Products go over a million entries at a time, so they need little memory beside the matrix.
    """

    def __init__(self, indices: list, values: list, labels: np.ndarray, weights: np.ndarray):
        """Takes the lists apart, so that entries are not held twice."""
        sizes = [len(i) for i in indices]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.indices = np.empty(self.first[-1], np.int32)
        self.values = np.empty(self.first[-1], np.float32)
        for row in range(len(sizes) - 1, -1, -1):
            own = slice(self.first[row], self.first[row + 1])
            self.indices[own], self.values[own] = indices.pop(), values.pop()
        self.labels = labels
        self.weights = weights

    def __len__(self) -> int:
        return len(self.labels)

    def _parts(self) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(self):
            hi = int(np.searchsorted(self.first, self.first[lo] + _ENTRIES, side="right")) - 1
            yield lo, (hi := max(hi, lo + 1))
            lo = hi

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for lo, hi in self._parts():
            own = slice(self.first[lo], self.first[hi])
            out[lo:hi] = spans.per_row(self.values[own] * weights[self.indices[own]], self.first[lo : hi + 1] - own.start)
        return out

    def transposed(self, by_row: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * BUCKETS)
        for lo, hi in self._parts():
            own = slice(self.first[lo], self.first[hi])
            spread = np.repeat(by_row[lo:hi], np.diff(self.first[lo : hi + 1]))
            out += np.bincount(self.indices[own], self.values[own] * spread, minlength=len(out))
        return out


def bounded_labels(labels: DataFrame, grade: str, grades: tuple[int, ...], limit: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``limit`` labelled ids of each grade, those with the smallest hashes, and the number
    of all ids of each grade. An id with contradicting or missing grades is left out."""
    agreed = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(grade).alias("grade"), F.max(grade).alias("highest"))
        .filter("grade = highest AND grade IS NOT NULL")
        .select("doc_id", F.col("grade").cast("int").alias("grade"))
    )
    sizes = {row["grade"]: row["n"] for row in agreed.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    parts = [agreed.filter(F.col("grade") == g).orderBy(_order(), "doc_id").limit(limit) for g in grades]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    return chosen, {g: sizes.get(g, 0) for g in grades}


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    grade: str,
    grades: tuple[int, ...],
    limit: int,
    max_bytes: int = SAMPLE_BYTES,
) -> Sample:
    """Features of a bounded sample of labelled documents, with weights that restore the share of
    each grade among all labels.

    The sample has at most ``limit`` documents of each grade, so their ids are broadcast, and at most
    ``max_bytes`` of features, an equal part for each grade: documents are taken in the order of their
    ids' hashes, whole, until the part is full (the first one always is). Rows that share an id are
    reduced to the one with the smallest text hash before features are made. Features are stored in
    the shared folder and reach the driver piece by piece.
    """
    chosen, sizes = bounded_labels(labels, grade, grades, limit)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                found = sparse_of(grams_of(block), block.rows)
                own = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"),
                        own.column("grade"),
                        pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()),
                        pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                    ],
                    ["doc_id", "grade", "indices", "features"],
                )

    met = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    single = met.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")
    )
    scratch = Scratch(docs.sparkSession, "sample")
    schema = "doc_id long, grade int, indices binary, features binary"
    stored = scratch.store(in_arrow(single, run, schema).repartition(_PIECES, "doc_id"))

    kept = _within(stored, max_bytes // max(len(grades), 1))
    found = {row["doc_id"]: row for row in stored.filter(F.col("doc_id").isin(kept)).toLocalIterator()} if kept else {}
    scratch.drop(stored)
    rows = [found.pop(i) for i in sorted(found)]
    grades_ = np.array([row["grade"] for row in rows], dtype=np.int64)
    drawn = {g: max(int((grades_ == g).sum()), 1) for g in grades}
    weights = np.array([sizes[g] / drawn[g] for g in grades_.tolist()])
    indices = [np.frombuffer(row["indices"], "<i4") for row in rows]
    values = [np.frombuffer(row["features"], "<f4") for row in rows]
    rows.clear()
    return Sample(indices, values, grades_, weights / max(weights.sum(), 1e-12))


def _within(stored: DataFrame, part: int) -> list[int]:
    """The ids of each grade whose features fit into ``part`` bytes, in the order of their hashes; one
    small row for each document of the sample comes to the driver."""
    size = (F.octet_length("indices") + F.octet_length("features")).cast("long").alias("size")
    used: dict[int, int] = {}
    kept = []
    for row in stored.select("doc_id", "grade", size, _order().alias("at")).orderBy("at", "doc_id").collect():
        before = used.get(row["grade"], 0)
        used[row["grade"]] = before + row["size"]
        if not before or before + row["size"] <= part:
            kept.append(row["doc_id"])
    return kept


def _order() -> Column:
    """The order in which labelled ids enter a sample."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit("sample"))


def minimise(
    start: np.ndarray, loss: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int = 60, memory: int = 8
) -> np.ndarray:
    """L-BFGS with a halving line search, for the small problems that the driver fits."""
    x = start.astype(float)
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way = slope.copy()
        kept = []
        for s, y, rho in reversed(steps):
            a = rho * (s @ way)
            kept.append(a)
            way -= a * y
        if steps:
            s, y, _ = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(kept)):
            way += s * (a - rho * (y @ way))
        fall = slope @ way
        if fall <= 0:
            way, fall, steps = slope, slope @ slope, []
        size = 1.0 if steps else min(1.0, 1.0 / max(np.sqrt(fall), 1e-12))
        while size > 1e-10:
            new = x - size * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1.0 / (s @ y))] if memory > 1 else []
        done = value - new_value < 1e-9 * max(abs(value), 1.0)
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=float)))
