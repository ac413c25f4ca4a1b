"""Schemas of Parquet files from their footers, read where the executors are.

Spark's reader infers a schema on the driver's behalf, a job for each question; merging the schemas
of many files in one job hides which file lacks a column. Here a job opens the footers of all files
and returns each one's schema in Spark's types. What it cannot read or name for certain (a file system
that only Spark knows, an old timestamp encoding, a nested column, no Parquet at all) it leaves open, for
Spark's reader to decide.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILES_PER_TASK = 64

# The tasks get this module's functions themselves, so the package need not be installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PHYSICAL = {
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
}
_LOGICAL = {
    ("INT32", "Int(bitWidth=8, isSigned=true)"): T.ByteType(),
    ("INT32", "Int(bitWidth=16, isSigned=true)"): T.ShortType(),
    ("INT32", "Int(bitWidth=32, isSigned=true)"): T.IntegerType(),
    ("INT64", "Int(bitWidth=64, isSigned=true)"): T.LongType(),
    ("INT32", "Date"): T.DateType(),
    ("BYTE_ARRAY", "String"): T.StringType(),
}
_TIMESTAMP = re.compile(r"Timestamp\(isAdjustedToUTC=(true|false), timeUnit=(?:milli|micro)seconds\b")


def spark_type(physical: str, logical: str) -> T.DataType | None:
    """Spark's type of a column, or None where this table does not decide it."""
    if logical == "None":
        return _PHYSICAL.get(physical)
    if physical == "INT64" and (stamp := _TIMESTAMP.match(logical)):
        return T.TimestampType() if stamp[1] == "true" else T.TimestampNTZType()
    return _LOGICAL.get((physical, logical))


def read_footer(path: str) -> str | None:
    """The schema of one file as JSON, or None when it is left to Spark's reader."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    location = re.sub(r"^(file:)/+", r"\1///", path) if ":" in path.split("/")[0] else f"file://{path}"
    try:
        system, inside = pyarrow.fs.FileSystem.from_uri(quote(location, safe="/:@=+,;~!$&'()*"))
        with system.open_input_file(inside) as file:
            found = pq.ParquetFile(file).schema
        columns = [found.column(i) for i in range(len(found))]
    except Exception:  # whatever the reason, Spark's reader says what is wrong with the file
        return None
    kinds = [spark_type(c.physical_type, str(c.logical_type)) for c in columns]
    if None in kinds or any(c.max_repetition_level or c.path != c.name for c in columns):
        return None
    return T.StructType([T.StructField(c.name, k) for c, k in zip(columns, kinds)]).json()


def footer_schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, schema)`` of every data file under the given files and folders; ``schema`` is JSON or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_footer(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "schema"])

    # Names and sizes only: the content is not read unless it is asked for.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    tasks = max(1, -(-len(listed.inputFiles()) // _FILES_PER_TASK))
    return listed.repartition(tasks, "path").mapInArrow(run, "path string, schema string")


def distinct_schemas(spark: SparkSession, paths: list[str], period: Column) -> DataFrame:
    """``(period, path, schema)``: the first file of each schema in a period, and every undecided file."""
    rows = footer_schemas(spark, paths).withColumn("period", period)
    undecided = F.when(F.col("schema").isNull(), F.col("path"))
    grouped = rows.groupBy("period", "schema", undecided.alias("_own")).agg(F.min("path").alias("path"))
    return grouped.select("period", "path", "schema")
