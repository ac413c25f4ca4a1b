"""Helpers that the operators share: table access, stored steps, connected groups."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.session import shared_dir

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one call in the shared folder. ``drop`` frees one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def path(self) -> str:
        self.count += 1
        return f"{self.base}/{self.count}"

    def store(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back: lost executors cost no recomputation beyond it."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def in_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the group's smallest node.

    Each round points every node at its smallest neighbour, doubles the pointers once and contracts
    the edges, so the edges shrink and the number of rounds follows the logarithm of the longest
    chain. Every round's tables are stored, so the plan does not grow. No edges: an empty table.
    """
    loose = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = scratch.store(loose.filter("a <> b").distinct())
    roots = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        smallest = both.groupBy(F.col("a").alias("at")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        hop = smallest.select(F.col("at").alias("mid"), F.col("up").alias("top"))
        doubled = smallest.join(hop, F.col("up") == F.col("mid"), "left")
        parents = scratch.store(doubled.select("at", F.coalesce("top", "up").alias("up")))
        moved = roots.join(parents, F.col("root") == F.col("at"), "left")
        new_roots = scratch.store(moved.select("node", F.coalesce("up", "root").alias("root")))
        first = left.join(parents, F.col("a") == F.col("at")).select(F.col("up").alias("c"), "b")
        second = first.join(parents, F.col("b") == F.col("at")).select("c", F.col("up").alias("d"))
        contracted = second.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
        rest = scratch.store(contracted.distinct())
        scratch.drop(left, parents, roots)
        left, roots = rest, new_roots
    return roots


def text_key(text: Column) -> Column:
    """A 128-bit name of a text; null has its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("-"))


_SHIPPED = "tripstrata-package"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tripstrata_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    # The driver serves this file to the executors for as long as the application runs.
    archive = f"{tempfile.mkdtemp()}/{_SHIPPED}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._tripstrata_shipped = True
