"""SimHash near-duplicates of documents by generalised pigeonhole search.

Texts become 64-bit fingerprints. Distinct fingerprints are linked when they differ in at most
``distance`` bits. Bits are grouped into parts, correlated bits together; each fingerprint gets its
own threshold for each part, by dynamic programming on estimated candidate counts, such that the
thresholds add up to ``distance - parts + 1`` (-1 leaves a part out). Any fingerprint within the
distance is then within the threshold of at least one part, so probing the part's values inside the
threshold finds every link; the full distance is verified in the join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, Scratch, components, in_arrow, text_key

BITS = 64
SHINGLE = 3
DISTANCE = 2
_U = np.uint64


def fingerprints_of(block: spans.Block, shingle: int = SHINGLE) -> np.ndarray:
    """One fingerprint a text: a bit is set if it is set in over half of the shingles' hashes."""
    data = spans.LOWER[block.data]
    found = spans.words(block, data, spans.NOT_BLANK)
    joined, at = spans.spaced(data, found)
    counts = found.counts
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(block.rows), number)
    start = np.arange(first[-1]) - first[row] + found.first[row]
    stop = np.minimum(start + shingle, found.first[row + 1]) - 1
    hashes = spans.xxh64(joined, at[start], at[stop] + found.lengths[stop] - at[start])
    ones = bit_counts(hashes, number)
    majority = (2 * ones > number[:, None]).astype(np.uint64)
    return (majority << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bit_counts(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each bit. Eight bits are added at once, in bytes of one
    word, over runs of at most 255 hashes; the runs are then added up."""
    out = np.zeros((len(number), BITS), dtype=np.int64)
    rows = np.flatnonzero(number)
    if not len(rows):
        return out
    runs = -(-number[rows] // 255)
    owner = np.repeat(np.arange(len(rows)), runs)
    run_first = np.cumsum(runs) - runs
    begin = (np.cumsum(number[rows]) - number[rows])[owner] + 255 * (np.arange(len(owner)) - run_first[owner])
    for shift in range(8):
        lanes = (hashes >> _U(shift)) & _U(0x0101010101010101)
        sums = np.add.reduceat(lanes, begin).view(np.uint8).reshape(-1, 8)
        out[np.ix_(rows, np.arange(shift, BITS, 8))] = np.add.reduceat(sums, run_first, axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*ids, fp)``, one row a document; null and wordless texts have fingerprint 0."""
    chosen = docs.select(*ids, "text")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                fp = fingerprints_of(block, shingle).view(np.int64)
                held = [batch.column(name).slice(block.lo, block.rows) for name in ids]
                yield pa.RecordBatch.from_arrays([*held, pa.array(fp)], [*ids, "fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("text").schema.fields]
    return in_arrow(chosen, run, ", ".join([*fields, "fp long"]))


def _as_bits(fp: np.ndarray) -> np.ndarray:
    return ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & _U(1)).astype(np.float64)


def correlations(distinct: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all distinct fingerprints.

    Each task adds up a 64 x 64 matrix; Spark adds these by row of the matrix, so 64 rows, whatever
    the input, reach the driver.
    """

    def run(batches: Batches) -> Batches:
        total = np.zeros((BITS, BITS))
        seen = 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 1 << 16):
                bits = _as_bits(fp[lo : lo + (1 << 16)])
                total += bits.T @ bits
                seen += len(bits)
        rows = pa.array(np.arange(BITS))
        both = pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([rows, pa.array(np.full(BITS, seen)), both], ["bit", "seen", "both"])

    parts = in_arrow(distinct.select("fp"), run, "bit long, seen long, both array<long>")
    sums = [F.sum(F.col("both")[i]).alias(f"b{i}") for i in range(BITS)]
    rows = sorted(parts.groupBy("bit").agg(F.sum("seen").alias("seen"), *sums).collect())
    if not rows or not rows[0]["seen"]:
        return np.zeros((BITS, BITS))
    n = rows[0]["seen"]
    both = np.array([row[2:] for row in rows], dtype=float) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size: each group starts at the free bit with the most
    correlation and takes in the free bit most correlated with its members."""
    free, groups = set(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        start = max(sorted(free), key=lambda bit: correlation[bit, sorted(free)].sum())
        group = [start]
        free.discard(start)
        while len(group) < size:
            nearest = max(sorted(free), key=lambda bit: correlation[bit, group].sum())
            group.append(nearest)
            free.discard(nearest)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fp), dtype=np.int64)
    for place, bit in enumerate(bits):
        value |= ((fp >> _U(bit)) & _U(1)).astype(np.int64) << place
    return value


def ball(bits: int, threshold: int) -> np.ndarray:
    """Masks of all values of ``bits`` bits with at most ``threshold`` set; none for -1."""
    return np.array(
        [sum(1 << b for b in picked) for k in range(threshold + 1) for picked in combinations(range(bits), k)],
        dtype=np.int64,
    )


def allocate(costs: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds for each row by dynamic programming.

    ``costs[r, i, t + 1]`` is the estimated work of part ``i`` under threshold ``t`` (-1 to
    ``distance``); the thresholds of a row add up to ``distance - parts + 1`` at the least cost.
    """
    rows, parts, levels = costs.shape
    span = parts * (distance + 1) + 1
    best = np.full((rows, span), np.inf)
    best[:, 0] = 0.0
    choice = np.zeros((rows, parts, span), dtype=np.int8)
    for part in range(parts):
        after = np.full((rows, span), np.inf)
        for level in range(levels):
            tried = best[:, : span - level] + costs[:, part, level, None]
            better = tried < after[:, level:]
            after[:, level:] = np.where(better, tried, after[:, level:])
            choice[:, part, level:] = np.where(better, level, choice[:, part, level:])
        best = after
    # Each level is a threshold plus one, so the levels add up to distance + 1.
    left = np.full(rows, distance + 1)
    out = np.zeros((rows, parts), dtype=np.int64)
    for part in reversed(range(parts)):
        out[:, part] = choice[np.arange(rows), part, left]
        left = left - out[:, part]
    return out - 1


def estimated(counts: np.ndarray, groups: list[list[int]], total: int, distance: int) -> np.ndarray:
    """Work of probing each part under each threshold: probes, plus expected candidates. The
    fingerprint's own value has a known count; values near it are taken to be as full as the part is
    on average, or a share of the own value's count where bits go together."""
    out = np.zeros((*counts.shape, distance + 2))
    for part, bits in enumerate(groups):
        for threshold in range(distance + 1):
            probes = len(ball(len(bits), threshold))
            average = total / 2.0 ** len(bits)
            near = (probes - 1) * np.maximum(average, counts[:, part] / (4.0 * len(bits)))
            out[:, part, threshold + 1] = probes + counts[:, part] + near
    return out


def parts_for(total: int, distance: int) -> int:
    """Fewer, wider parts as the number of fingerprints grows, so that a value stays selective."""
    for parts in range(distance + 2, 1, -1):
        if total <= 4 * 2 ** (BITS // parts):
            return parts
    return 2


def links(distinct: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints within ``distance`` bits."""
    total = distinct.count()
    parts = parts_for(total, distance)
    groups = group_bits(correlations(distinct), parts)

    def index(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column("fp").to_numpy()
            for part, bits in enumerate(groups):
                values = part_values(column.view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(column), part)), pa.array(values), pa.array(column)], ["part", "value", "fp"]
                )

    def probe(batches: Batches) -> Batches:
        balls = [[ball(len(bits), t) for t in range(distance + 1)] for bits in groups]
        for batch in batches:
            column = batch.column("fp").to_numpy()
            held = np.array(batch.column("counts").to_pylist(), dtype=float).reshape(-1, parts)
            for lo in range(0, len(column), 4096):
                fp = column[lo : lo + 4096]
                levels = allocate(estimated(held[lo : lo + 4096], groups, total, distance), distance)
                for part, bits in enumerate(groups):
                    values = part_values(fp.view(np.uint64), bits)
                    for threshold in range(distance + 1):
                        picked = np.flatnonzero(levels[:, part] == threshold)
                        if not len(picked):
                            continue
                        masks = balls[part][threshold]
                        probes = (values[picked][:, None] ^ masks[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(probes), part)),
                                pa.array(probes),
                                pa.array(np.repeat(fp[picked], len(masks))),
                            ],
                            ["part", "value", "fp"],
                        )

    schema = "part long, value long, fp long"
    entries = scratch.store(in_arrow(distinct.select("fp"), index, schema))
    sizes = entries.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    per_part = [F.max(F.when(F.col("part") == p, F.col("n"))) for p in range(parts)]
    counted = entries.join(sizes, ["part", "value"]).groupBy("fp").agg(F.array(*per_part).alias("counts"))
    probes = in_arrow(counted, probe, schema).select("part", "value", F.col("fp").alias("a"))
    found = probes.join(entries.withColumnRenamed("fp", "b"), ["part", "value"]).filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    return found.select("a", "b").distinct()


def grouped(prints: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """``(fp, root)``: every distinct fingerprint of the stored ``prints``, and the smallest one that
    links reach from it."""
    distinct = scratch.store(prints.select("fp").distinct())
    roots = components(links(distinct, scratch, distance), scratch)
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs (doc_id, text, ...)``.

    Null and wordless texts have fingerprint 0 and are linked like any other. ``component_id`` is the
    smallest ``doc_id`` that links reach, the row's own included; null ids are passed over, so it is
    null only where all ids of a group are. Repeated rows share a fingerprint and stay. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.store(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shingle))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    member = scratch.store(grouped(prints, scratch, distance).join(first, "fp"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = member.join(smallest, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (null ids come last), and of
    these with the smallest text hash. Rows that repeat both id and text are one document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    prints = scratch.store(fingerprints(keyed, shingle, ("doc_id", "__key")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))
    by_print = prints.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = grouped(prints, scratch, distance).join(by_print, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = scratch.store(firsts.select("first.id", "first.key").distinct())
    same = keyed["doc_id"].eqNullSafe(kept["id"]) & (keyed["__key"] == kept["key"])
    return keyed.join(kept, same, "left_semi").drop("__key")
