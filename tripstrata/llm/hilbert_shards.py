"""Sharding along a Hilbert curve, so that each file holds a small box of several dimensions.

Each metadata dimension is cut into levels of about equal numbers of rows; the levels are the
coordinates of a cell, and rows are sorted by the cell's place on the Hilbert curve. Runs of equal
length are the shards: their files have narrow minima and maxima in every dimension at once.

DataFrame expressions only. The sort is by range with ties broken down to the id, so a cell that
holds a third of all rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm.tables import Scratch

SHARDS = 40
#: Levels of each dimension as a power of two.
BITS = 5
DIMENSIONS = ("source", "lang", "n_chars")
#: Bytes that a record takes besides its text.
OVERHEAD = 16
_ROW_BITS = 33


def as_number(df: DataFrame, name: str) -> Column:
    """A dimension as a number in its own order; text by its first six bytes."""
    if df.schema[name].dataType.typeName() != "string":
        return F.col(f"`{name}`").cast("double")
    head = F.rpad(F.hex(F.substring(F.col(f"`{name}`").cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def cuts(df: DataFrame, dims: tuple[str, ...], bits: int) -> dict[str, list[float]]:
    """The bounds between the levels of each dimension: quantiles over all rows, at most 2^bits - 1."""
    points = [i / 2**bits for i in range(1, 2**bits)]
    row = df.agg(*(F.percentile_approx(as_number(df, d), points, 10_000).alias(f"c{i}") for i, d in enumerate(dims)))
    found = row.first()
    return {d: sorted({float(v) for v in found[f"c{i}"] or []}) for i, d in enumerate(dims)}


def level(number: Column, bounds: list[float]) -> Column:
    """How many bounds are below the value; 0 for null."""
    below = F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound < number)
    return F.when(number.isNull(), 0).otherwise(F.size(below)).cast("long")


def with_hilbert(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the Hilbert index of the long columns ``axes`` (each below 2^bits) instead of them.

    The steps are those of the transposed form: undo the excess work from the high bit down, Gray
    encode, interleave. Each step is a projection of its own, so no expression repeats another.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in axes]

    def step(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
        return df.select(*others, *(changed.get(a, F.col(a)).alias(a) for a in axes))

    first = axes[0]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in axes:
            is_set = F.shiftright(F.col(axis), bit).bitwiseAND(F.lit(1)) == 1
            if axis == first:
                df = step(df, {first: F.when(is_set, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first))})
                continue
            swap = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(F.lit(low))
            df = step(
                df,
                {
                    first: F.col(first).bitwiseXOR(F.when(is_set, F.lit(low).cast("long")).otherwise(swap)),
                    axis: F.when(is_set, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap)),
                },
            )
    for before, axis in zip(axes, axes[1:]):
        df = step(df, {axis: F.col(axis).bitwiseXOR(F.col(before))})
    turn = F.lit(0).cast("long")
    for bit in range(bits - 1, 0, -1):
        is_set = F.shiftright(F.col(axes[-1]), bit).bitwiseAND(F.lit(1))
        turn = turn.bitwiseXOR(is_set * F.lit((1 << bit) - 1))
    df = df.withColumn("__turn", turn)
    others.append(F.col("__turn"))
    df = step(df, {axis: F.col(axis).bitwiseXOR(F.col("__turn")) for axis in axes})
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(axis), bit).bitwiseAND(F.lit(1)))
    return df.select(*others[:-1], index.alias(name))


def curve_index(docs: DataFrame, columns: list[Column], dims: tuple[str, ...], bits: int) -> DataFrame:
    """``columns`` of ``docs`` and its place on the curve, ``hilbert``."""
    bounds = {d: found for d, found in cuts(docs, dims, bits).items() if found}
    if not bounds:
        return docs.select(*columns, F.lit(0).cast("long").alias("hilbert"))
    # A dimension without values has no part in the curve.
    axes = [f"__axis{i}" for i in range(len(bounds))]
    levels = [level(as_number(docs, d), found).alias(a) for (d, found), a in zip(bounds.items(), axes)]
    return with_hilbert(docs.select(*columns, *levels), axes, bits, "hilbert")


def assign(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``(doc_id, size, text_crc32, hilbert, shard, slot)``, one row for each row of ``docs``.

    Ranks along the curve are cut into ``shards`` runs whose counts differ by one at most; slots are
    gapless from 0. ``size`` is the text's UTF-8 bytes (null: none) plus ``OVERHEAD``. Rows of one cell
    stand by checksum, size and id, so equal texts of a cell stand together; repeated rows each get a
    slot of their own. A null dimension is level 0, a null id comes first among its ties. An empty
    table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    columns = [
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ]
    order = ["hilbert", "text_crc32", "size", "doc_id"]
    sorted_rows = curve_index(docs, columns, dims, bits).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.store(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", _ROW_BITS).alias("task")
    sizes = placed.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    # One row a task: this window sees as many rows as there are partitions.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    ranked = placed.withColumn("task", task).join(offsets, "task")
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    ranked = ranked.withColumn("shard", F.expr(f"int(rank * {shards} div total)"))
    # The first rank of a shard is shard * total / shards, rounded up.
    slot = F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", "shard", slot.alias("slot"))


def write_files(docs: DataFrame, path: str, files: int = SHARDS, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> None:
    """All columns of ``docs`` in about ``files`` Parquet files along the curve, for pruning by
    minimum and maximum."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    along = curve_index(docs, columns, dims, bits)
    order = ["hilbert", *(c for c in ("doc_id",) if c in docs.columns)]
    along.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("hilbert").write.parquet(path)
