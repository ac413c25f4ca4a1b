"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of about a megabyte. Each segment is one row of the index: its sorted
term hashes, the length of each posting list, and the word positions as gaps. The index is written
once to the shared folder. Test items are cut into windows of consecutive words, which are looked up
against all segments in blocks of bounded size. In a segment, a window with an absent term is given
up at once; of the others, the posting lists are shifted by the term's place in the window and
intersected, from the rarest term of that segment on.

Terms are compared by their 64-bit hashes (XXH64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, Scratch, in_arrow, text_key

WINDOW = 10
SLOP = 5
SEGMENT_BYTES = 1 << 20
#: Windows in one pass over the index: about 5 MB of term hashes, whatever the number of items.
QUERY_BLOCK = 50_000

HIT_SCHEMA = (
    "segment string, place int, hits array<struct<start:int,stop:int>>, items array<long>, near array<long>"
)


def terms_of(block: spans.Block) -> tuple[np.ndarray, spans.Words]:
    data = spans.LOWER[block.data]
    found = spans.words(block, data, spans.ALNUM)
    return spans.xxh64(data, found.starts, found.lengths), found


# --- The index --------------------------------------------------------------------------------


def build_index(docs: DataFrame, scratch: Scratch, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored index of ``docs``: one row a segment, with the ``ids`` of its documents."""
    chosen = docs.select(F.struct(*ids).alias("id"), "text")
    id_type = chosen.schema["id"].dataType.simpleString()
    schema = (
        f"segment string, ids array<{id_type}>, n_words array<int>, terms binary, sizes binary, gaps binary"
    )

    def run(batches: Batches) -> Batches:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in spans.blocks(batch.column("text"), SEGMENT_BYTES):
                hashes, found = terms_of(block)
                order = np.argsort(hashes, kind="stable")
                sorted_hashes = hashes[order]
                begin = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])[: len(order)])
                gaps = np.diff(order, prepend=0)
                gaps[begin] = order[begin]
                sizes = np.diff(np.append(begin, len(order)))
                held = batch.column("id").slice(block.lo, block.rows)
                counts = pa.array(found.counts.astype(np.int32))
                offsets = pa.array([0, block.rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{number}"]),
                        pa.ListArray.from_arrays(offsets, held),
                        pa.ListArray.from_arrays(offsets, counts),
                        *(
                            pa.array([part.tobytes()], pa.binary())
                            for part in (sorted_hashes[begin], sizes.astype("<u4"), gaps.astype("<u4"))
                        ),
                    ],
                    ["segment", "ids", "n_words", "terms", "sizes", "gaps"],
                )
                number += 1

    return scratch.store(in_arrow(chosen, run, schema))


# --- The test items ---------------------------------------------------------------------------


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(item_id, terms)``: each window of ``width`` words, or the whole of a shorter item."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                hashes, found = terms_of(block)
                ids = batch.column("item_id").slice(block.lo, block.rows).to_pylist()
                signed = hashes.view(np.int64)
                out_ids, out_terms = [], []
                for row, item in enumerate(ids):
                    own = signed[found.first[row] : found.first[row + 1]].tolist()
                    for at in range(max(len(own) - width + 1, min(len(own), 1))):
                        out_ids.append(item)
                        out_terms.append(own[at : at + width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_ids, pa.int64()), pa.array(out_terms, pa.list_(pa.int64()))], ["item_id", "terms"]
                )

    return in_arrow(items.select("item_id", "text"), run, "item_id long, terms array<long>")


class Windows:
    """A block of windows: distinct term lists as rows of numbers into ``terms``, -1 after the end."""

    def __init__(self, rows: list[tuple[int | None, list[int]]], width: int):
        matrix = np.zeros((len(rows), width), dtype=np.int64)
        sizes = np.array([len(terms) for _, terms in rows])
        for row, (_, terms) in enumerate(rows):
            matrix[row, : len(terms)] = terms
        keyed = np.column_stack([matrix, sizes])
        distinct, owner = np.unique(keyed, axis=0, return_inverse=True)
        owner = owner.ravel()
        self.sizes = distinct[:, -1]
        inside = np.arange(width) < self.sizes[:, None]
        self.terms = np.unique(distinct[:, :-1][inside].view(np.uint64))
        self.places = np.where(inside, np.searchsorted(self.terms, distinct[:, :-1].view(np.uint64)), -1)
        by_window = np.argsort(owner, kind="stable")
        self.items = [rows[i][0] for i in by_window]
        self.first = np.searchsorted(owner[by_window], np.arange(len(distinct) + 1))

    def items_of(self, window: int) -> list:
        return self.items[self.first[window] : self.first[window + 1]]


def window_blocks(items: DataFrame, width: int, limit: int = QUERY_BLOCK) -> Iterator[Windows]:
    """All windows of all items; the driver holds one block at a time."""
    held: list = []
    for row in item_windows(items, width).toLocalIterator():
        held.append((row["item_id"], row["terms"]))
        if len(held) == limit:
            yield Windows(held, width)
            held = []
    if held:
        yield Windows(held, width)


# --- The search -------------------------------------------------------------------------------


class Segment:
    """Posting lists of the terms that a block of windows asks for."""

    def __init__(self, terms: bytes, sizes: bytes, gaps: bytes, asked: np.ndarray):
        self.gaps = np.frombuffer(gaps, "<u4")
        own = np.frombuffer(terms, np.uint64)
        lengths = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(own, asked)
        inside = at < len(own)
        inside[inside] = own[at[inside]] == asked[inside]
        self.at = np.where(inside, at, -1)
        self.lengths = np.where(inside, lengths[np.minimum(at, len(own) - 1)] if len(own) else 0, 0)
        self.lists: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        if term not in self.lists:
            at = self.at[term]
            self.lists[term] = np.cumsum(self.gaps[self.begin[at] : self.begin[at + 1]], dtype=np.int64)
        return self.lists[term]


def _contains(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, asked)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == asked


def phrase_starts(segment: Segment, places: np.ndarray) -> np.ndarray:
    """Where the terms stand one after the other."""
    order = np.argsort(segment.lengths[places], kind="stable")
    starts = segment.postings(places[order[0]]) - order[0]
    starts = starts[starts >= 0]
    for offset in order[1:]:
        if not len(starts):
            break
        starts = starts[_contains(segment.postings(places[offset]), starts + offset)]
    return starts


def near_places(segment: Segment, places: np.ndarray, reach: int, row_first: np.ndarray) -> np.ndarray:
    """Occurrences of the rarest term with every other term at most ``reach`` words away in the same
    text, in any order."""
    order = np.argsort(segment.lengths[places], kind="stable")
    anchors = segment.postings(places[order[0]])
    owner = np.searchsorted(row_first, anchors, side="right") - 1
    low = np.maximum(anchors - reach, row_first[owner])
    high = np.minimum(anchors + reach, row_first[owner + 1] - 1)
    for offset in order[1:]:
        if not len(anchors):
            break
        other = segment.postings(places[offset])
        fits = np.searchsorted(other, high, side="right") > np.searchsorted(other, low, side="left")
        anchors, low, high = anchors[fits], low[fits], high[fits]
    return anchors


def search_block(index: DataFrame, windows: Windows, slop: int | None) -> DataFrame:
    """One row for each document of the index that a window of the block matches."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column("segment")[row].as_py()
                counts = np.array(batch.column("n_words")[row].as_py() or [], dtype=np.int64)
                segment = Segment(*(batch.column(c)[row].as_py() for c in ("terms", "sizes", "gaps")), windows.terms)
                yield from found_in(name, counts, segment)

    def found_in(name: str, counts: np.ndarray, segment: Segment) -> Batches:
        row_first = np.concatenate([[0], np.cumsum(counts)])
        there = np.append(segment.lengths > 0, True)  # the last stands for "no term"
        hits: dict[int, list[dict]] = {}
        items: dict[int, set] = {}
        near: dict[int, set] = {}
        for window in np.flatnonzero(there[windows.places].all(axis=1)).tolist():
            size = int(windows.sizes[window])
            places = windows.places[window, :size]
            starts = phrase_starts(segment, places)
            owner = np.searchsorted(row_first, starts, side="right") - 1
            whole = starts + size <= row_first[owner + 1]
            for place, start in zip(owner[whole].tolist(), (starts - row_first[owner])[whole].tolist()):
                hits.setdefault(place, []).append({"start": start, "stop": start + size})
                items.setdefault(place, set()).update(windows.items_of(window))
            if slop is not None:
                anchors = near_places(segment, places, size - 1 + slop, row_first)
                for place in np.unique(np.searchsorted(row_first, anchors, side="right") - 1).tolist():
                    near.setdefault(place, set()).update(windows.items_of(window))
        rows = [
            {
                "segment": name,
                "place": place,
                "hits": hits.get(place, []),
                "items": sorted(i for i in items.get(place, ()) if i is not None),
                "near": sorted(i for i in near.get(place, ()) if i is not None),
            }
            for place in sorted({*hits, *near})
        ]
        if rows:
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            kinds = [
                ("segment", pa.string()),
                ("place", pa.int32()),
                ("hits", pa.list_(span)),
                ("items", pa.list_(pa.int64())),
                ("near", pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return in_arrow(index.select("segment", "n_words", "terms", "sizes", "gaps"), run, HIT_SCHEMA)


def _covered(hits: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(seen: Column, span: Column) -> Column:
        new = F.greatest(span["stop"] - F.greatest(span["start"], seen["upto"]), F.lit(0))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["upto"], span["stop"]).alias("upto"))

    return F.aggregate(F.array_sort(hits), start, add, lambda seen: seen["n"])


def matches(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    slop: int | None = SLOP,
    ids: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``(*ids, n_words, n_hit, items, near_items)``, one row for each row of ``docs``.

    ``n_hit`` counts the words inside an occurrence of a window of ``items (item_id, text)``; ``items``
    are the ids with an occurring window, ``near_items`` those with a window whose words all stand
    within ``width - 1 + slop`` words of its rarest, in any order (empty when ``slop`` is None).
    Null and wordless texts have no words and no hits; items without words match nothing; an item
    with a null id is searched, its words count as hit, but no id is listed. Repeated rows are
    answered one by one. An empty table on either side gives no rows, or no hits.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    index = build_index(docs, scratch, ids)
    found = None
    for windows in window_blocks(items, width):
        part = search_block(index, windows, slop)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], HIT_SCHEMA)

    def joined(name: str) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    merged = found.groupBy("segment", "place").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), joined("items"), joined("near")
    )
    merged = merged.select("segment", "place", _covered(F.col("hits")).alias("n_hit"), "items", "near")
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "doc"))
    none = F.array().cast("array<long>")
    return rows.join(merged, ["segment", "place"], "left").select(
        *(F.col(f"doc.ids.{name}").alias(name) for name in ids),
        F.col("doc.n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near", none).alias("near_items"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the items occurs, unchanged."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    found = matches(keyed, items, width, None, ("doc_id", "__key")).filter("n_hit > 0")
    # Stored, so its size is known: it is broadcast if small, else both sides are shuffled.
    hit = scratch.store(found.select(F.col("doc_id").alias("id"), F.col("__key").alias("key")).distinct())
    same = keyed["doc_id"].eqNullSafe(hit["id"]) & (keyed["__key"] == hit["key"])
    return keyed.join(hit, same, "left_anti").drop("__key")
