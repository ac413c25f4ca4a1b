"""A streaming query's own log as tables: batches, their commits, the files each read, and its state.

A checkpoint holds one small text file for each batch: what the batch was to read, written before it
runs, and that it is done, written after. The file source keeps a third log of which file belongs to
which batch. Read as tables they answer, for a query that runs, was stopped or failed, what has been
processed and what has not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

_OFFSET = "batchWatermarkMs bigint, batchTimestampMs bigint"
_COMMIT = "nextBatchWatermarkMs bigint"
_ENTRY = "path string, timestamp bigint, batchId bigint"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """``(batch_id, position, line)`` of a log folder; compacted files hold all that came before them.

    The first line of each file is its version. Half-written files have other names and are not read.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], "batch_id bigint, position int, line string")
    names = [name for name in files.children(spark, path) if name.removesuffix(".compact").isdigit()]
    if not names:
        return spark.createDataFrame([], "batch_id bigint, position int, line string")
    # The folder is listed, not each file: names that are no batches are left out by the pattern.
    texts = spark.read.option("pathGlobFilter", "[0-9]*").text(path, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)(?:\.compact)?$", 1)
    lines = texts.where(number != "").select(number.cast("bigint").alias("batch_id"), F.posexplode(F.split("value", "\n")))
    return lines.where("pos > 0 AND col <> ''").select("batch_id", F.col("pos").alias("position"), F.col("col").alias("line"))


def stream_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(batch_id, planned_at, watermark, committed, next_watermark)``, one row for each batch planned."""

    def moment(name: str) -> Column:
        return F.timestamp_millis(F.col(name))

    planned = (
        _entries(spark, f"{checkpoint}/offsets")
        .where("position = 1")
        .select("batch_id", F.from_json("line", _OFFSET).alias("o"))
        .select("batch_id", moment("o.batchTimestampMs").alias("planned_at"), moment("o.batchWatermarkMs").alias("watermark"))
    )
    done = (
        _entries(spark, f"{checkpoint}/commits")
        .where("position = 1")
        .select(F.col("batch_id").alias("_done"), F.from_json("line", _COMMIT).alias("c"))
        .select("_done", moment("c.nextBatchWatermarkMs").alias("next_watermark"))
    )
    joined = planned.join(done, F.col("batch_id") == F.col("_done"), "left")
    return joined.select("batch_id", "planned_at", "watermark", F.col("_done").isNotNull().alias("committed"), "next_watermark")


def source_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """``(batch_id, path, modified_at)``: every file that the query's file source gave to a batch.

    An entry that stands in a compacted file and in its own is one row; a file given to two batches is two.
    """
    parsed = _entries(spark, f"{checkpoint}/sources/{source}").select(F.from_json("line", _ENTRY).alias("e"))
    rows = parsed.where("e.path IS NOT NULL").select(
        F.col("e.batchId").alias("batch_id"),
        F.col("e.path").alias("path"),
        F.timestamp_millis(F.col("e.timestamp")).alias("modified_at"),
    )
    return rows.distinct()


def path_key(path: Column) -> Column:
    """A path without scheme and host, decoded, so that logs and listings agree on it."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))


def audit_files(spark: SparkSession, checkpoint: str, topic: str) -> DataFrame:
    """``(file, batches, committed_batches, in_topic)`` for every file of the log or of the topic's folder.

    A query that lost nothing and repeated nothing shows one batch, committed, for each file in the topic.
    """
    # Names, not rows: a read skips files without a byte, which a stream is given like any other.
    names = spark.read.option("recursiveFileLookup", "true").text(topic).inputFiles()
    listed = spark.createDataFrame([(name,) for name in names], "path string").select(path_key(F.col("path")).alias("file"))
    done = stream_batches(spark, checkpoint).where("committed").select(F.col("batch_id").alias("_done"))
    logged = source_files(spark, checkpoint).join(done, F.col("batch_id") == F.col("_done"), "left")
    counted = logged.groupBy(path_key(F.col("path")).alias("file")).agg(
        F.count_distinct("batch_id").alias("batches"), F.count_distinct("_done").alias("committed_batches")
    )
    joined = counted.join(listed.withColumn("in_topic", F.lit(True)), "file", "full_outer")
    return joined.fillna(0, ["batches", "committed_batches"]).fillna(False, ["in_topic"])


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Keys and values that the query's stateful operator holds after its last committed batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint).select("key.*", "value.*")
