"""Audit of filters that run one after the other: what each removes, alone and behind the others.

Every document gets a mask of the filters it fails. Four are decided by its own text; the fifth, being
an exact copy of a document with a smaller id, needs the whole table. Texts are inserted into radix
tries, first in the tasks that read them, where copies within a task's block fold into one terminal,
then, range-partitioned by text prefixes long enough to split them, into tries that see all texts of a
prefix. Only the smallest id of a text in a block crosses the network. Masks are then counted, and the
120 orders of the filters are read off the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.tables import Batches, Scratch, in_arrow

#: The filters in the order of their bits, and what they compare.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

COPY = 1 << FILTERS.index("E")

#: Bytes of text that one trie of a reading task takes before it is emptied.
BLOCK_BYTES = 32 << 20
#: A prefix that stands for more bytes than this is lengthened, by this factor, from this length on.
PREFIX_BYTES = 64 << 20
FIRST_PREFIX = 16
LENGTHEN = 4
#: Bytes that one range of prefixes should hold.
RANGE_BYTES = 64 << 20
#: Rows in one batch that a task hands on.
_ROWS = 2048
_BATCH_BYTES = 4 << 20


def text_mask(text: str, raw: bytes) -> int:
    """Bits of the filters that a text fails by itself; ``raw`` is the text in UTF-8."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > MAX_UPPER_PERCENT * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


class _Node:
    __slots__ = ("label", "children", "smallest", "mask", "parts")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        #: Of a terminal: the smallest id, the text's mask, and how many rows of that id each part has.
        self.smallest: int | None = None
        self.mask = 0
        self.parts: Counter | None = None


def _common(text: bytes, at: int, label: bytes) -> int:
    """Bytes that ``label`` shares with ``text`` from ``at`` on, by bisection."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Texts as bytes along compressed edges, the smallest id of each at its terminal."""

    def __init__(self):
        self.root = _Node(b"")

    def terminal(self, text: bytes) -> _Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                return child
            shared = _common(text, at, child.label)
            if shared < len(child.label):
                upper = node.children[text[at]] = _Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                child = upper
            node, at = child, at + shared
        return node

    def insert(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> Iterator[tuple[int, str, int, int]]:
        """Yields the rows that this insertion shows to be copies of a smaller id."""
        end = self.terminal(text)
        if end.smallest is not None and doc_id > end.smallest:
            yield doc_id, part, mask | COPY, n
            return
        if end.smallest is not None and doc_id < end.smallest:
            for other, many in end.parts.items():
                yield end.smallest, other, end.mask | COPY, many
            end.smallest = None
        if end.smallest is None:
            end.smallest, end.mask, end.parts = doc_id, mask, Counter()
        end.parts[part] += n

    def terminals(self) -> Iterator[tuple[bytes, _Node]]:
        """All texts in byte order with their terminals."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node.label
            if node.smallest is not None:
                yield text, node
            stack.extend((text, node.children[key]) for key in sorted(node.children, reverse=True))


_FIELDS = pa.schema(
    [("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
)
_SCHEMA = "text binary, doc_id long, part string, mask int, n long"


def _batches(rows: Iterator[tuple]) -> Batches:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[0] or b"")
        if len(held) >= _ROWS or size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FIELDS)], schema=_FIELDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FIELDS)], schema=_FIELDS)


def local_minima(docs: DataFrame, text: str, key: str, part: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(text, doc_id, part, mask, n)``: each text of a block once for the rows of its smallest id
    there, and, without their text, the rows already known to be copies or to have no id."""

    def rows(batches: Batches) -> Iterator[tuple]:
        trie, size = RadixTrie(), 0
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("text", "doc_id", "part"))
            for content, doc_id, own in zip(*columns):
                raw = content.encode()
                mask = text_mask(content, raw)
                if doc_id is None:
                    yield None, None, own, mask, 1
                    continue
                for known in trie.insert(raw, doc_id, own, mask, 1):
                    yield None, *known
                size += len(raw)
                if size >= block_bytes:
                    yield from emptied(trie)
                    trie, size = RadixTrie(), 0
        yield from emptied(trie)

    def emptied(trie: RadixTrie) -> Iterator[tuple]:
        for content, end in trie.terminals():
            for own, many in end.parts.items():
                yield content, end.smallest, own, end.mask, many

    def run(batches: Batches) -> Batches:
        yield from _batches(rows(batches))

    chosen = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    return in_arrow(chosen, run, _SCHEMA)


def _start(length: int) -> Column:
    return F.substring("text", 1, length)


def with_prefix(texts: DataFrame, scratch: Scratch, limit: int = PREFIX_BYTES, first: int = FIRST_PREFIX) -> DataFrame:
    """``texts`` with a ``prefix``: the first bytes of the text, as many as leave at most ``limit`` bytes
    of texts to a prefix. A prefix is lengthened while it stands for more and some text goes on
    behind it, so equal texts always get equal prefixes and only one text's copies can exceed it."""
    length, open_rows, prefix, tables = first, texts, _start(first), []
    while True:
        sizes = open_rows.groupBy(_start(length).alias("start")).agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest")
        )
        heavy = scratch.store(sizes.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("start"))
        if heavy.isEmpty():
            break
        tables.append((length, heavy))
        open_rows = texts.join(heavy, _start(length) == F.col("start"), "left_semi")
        length *= LENGTHEN
    out = texts.withColumn("prefix", prefix)
    for at, heavy in tables:
        longer = heavy.select(F.col("start").alias("prefix"), F.lit(True).alias("heavy"))
        out = out.join(longer, "prefix", "left").select(
            *texts.columns, F.when(F.col("heavy"), _start(at * LENGTHEN)).otherwise(F.col("prefix")).alias("prefix")
        )
    return out


def flagged(texts: DataFrame, scratch: Scratch, prefix_bytes: int = PREFIX_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(text, doc_id, part, mask, n)`` of the rows that carry a text, with the bit for copies; the
    text itself stays behind."""

    def rows(batches: Batches) -> Iterator[tuple]:
        trie, prefix = RadixTrie(), None
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("prefix", *_FIELDS.names))
            for start, content, doc_id, own, mask, n in zip(*columns):
                if start != prefix:
                    yield from emptied(trie)
                    trie, prefix = RadixTrie(), start
                for known in trie.insert(content, doc_id, own, mask, n):
                    yield None, *known
        yield from emptied(trie)

    def emptied(trie: RadixTrie) -> Iterator[tuple]:
        for _, end in trie.terminals():
            for own, many in end.parts.items():
                yield None, end.smallest, own, end.mask, many

    def run(batches: Batches) -> Batches:
        yield from _batches(rows(batches))

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes), min(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    prefixed = with_prefix(texts, scratch, prefix_bytes)
    dealt = prefixed.repartitionByRange(int(ranges), "prefix").sortWithinPartitions("prefix")
    return in_arrow(dealt.select("prefix", *_FIELDS.names), run, _SCHEMA)


def masks(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    text: str = "text",
    key: str = "doc_id",
    part: str = "lang",
    block_bytes: int = BLOCK_BYTES,
    prefix_bytes: int = PREFIX_BYTES,
) -> DataFrame:
    """``(part, mask, good, toxic, n)``: how many documents of a part fail exactly the filters of a mask."""
    local = scratch.store(local_minima(docs, text, key, part, block_bytes))
    settled = local.filter("text IS NULL")
    rest = flagged(local.filter("text IS NOT NULL"), scratch, prefix_bytes)
    # A repeated id is counted before it meets its label.
    by_id = settled.union(rest).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    both = by_id.join(judged, "doc_id", "left")
    flags = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("good", "toxic")]
    return both.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``(filter_order, step, bit, before)`` of all orders of the filters: 600 rows for five."""
    rows = []
    for order in permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    part: str = "lang",
    block_bytes: int = BLOCK_BYTES,
    prefix_bytes: int = PREFIX_BYTES,
) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)``: one row for each part, order of the filters and step, zeros included.

    A null text is an empty one, a null part the empty string. A row without id is no copy, and no
    other row is a copy of it; rows with equal ids are not copies of each other. Repeated rows all
    count. A document is good (toxic) if any of its label rows says so; rows without label are
    neither. Other columns of ``docs`` are not read. An empty table has no part and gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "filter-audit")
    counts = scratch.store(masks(docs, labels, scratch, text, key, part, block_bytes, prefix_bytes))
    # What a filter does depends on the filters before it, not on their order: 80 cases for 600 rows.
    steps = orders(spark)
    cases = [(r["bit"], r["before"]) for r in steps.select("bit", "before").distinct().orderBy("bit", "before").collect()]
    literal = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in cases))
    fails = F.col("mask").bitwiseAND(F.col("case.bit")) != 0
    reached = F.col("mask").bitwiseAND(F.col("case.before")) == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    by_case = (
        counts.withColumn("case", F.explode(literal))
        .groupBy("part", "case.bit", "case.before")
        .agg(
            total(reached & ~fails).alias("kept"),
            total(reached & fails).alias("removed"),
            total(~reached & fails).alias("redundant"),
            total(F.col("mask") == F.col("case.bit")).alias("unique_fails"),
            total(reached & fails & (F.col("good") == 1)).alias("good_lost"),
            total(reached & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
        )
    )
    full = by_case.join(F.broadcast(steps), ["bit", "before"])
    shapley = full.groupBy(F.col("part").alias("of_part"), F.col("bit").alias("of_bit")).agg(F.sum("removed").alias("shapley"))
    joined = full.join(shapley, (F.col("part") == F.col("of_part")) & (F.col("bit") == F.col("of_bit")))
    return joined.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
