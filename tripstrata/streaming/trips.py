"""Trip events as a stream: reading, decoding, hourly windows and their sinks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from .. import schemas
from ..functions.fixed_point import exact_sum
from ..sources import files

_CORRUPT = "_corrupt"
_EVENT = T.StructType([*schemas.SILVER.fields, T.StructField(_CORRUPT, T.StringType())])


def decode_trips(events: DataFrame) -> DataFrame:
    """Trips from JSON text in ``value``; an event that does not decode is skipped.

    ``inline`` over a filtered one-element array parses each text once. A plain filter on the
    parsed struct would be pushed below it and parse again.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    trip = F.from_json(F.col("value").cast("string"), _EVENT, options)
    decoded = F.filter(F.array(trip), lambda t: t.isNotNull() & t[_CORRUPT].isNull())
    return events.select(F.inline(decoded)).drop(_CORRUPT)


def stream_trips(
    spark: SparkSession,
    path: str | None = None,
    brokers: str | None = None,
    since: datetime | None = None,
    starting_offsets: str = "earliest",
    max_files: int | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Decoded trips from a folder of JSON lines, or from the Kafka topic when brokers are given.

    ``starting_offsets="latest"`` skips the backlog; for a folder, files older than ``since`` (now, if
    not given). With the query's ``checkpoint`` that moment is stored beside it at the first start and
    used again at every other, so what arrives while the query is stopped is read after a restart.
    """
    if starting_offsets not in ("earliest", "latest"):
        raise ValueError("starting_offsets must be earliest or latest")
    if brokers:
        events = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", C.TOPIC)
            .option("startingOffsets", starting_offsets)
            .load()
        )
        return decode_trips(events)
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    events = reader.load(path)
    if starting_offsets == "latest":
        start = _first_start(spark, since or datetime.now().astimezone(), checkpoint)
        events = events.where(F.col("_metadata.file_modification_time") >= F.lit(start))
    return decode_trips(events)


def _first_start(spark: SparkSession, moment: datetime, checkpoint: str | None) -> datetime:
    if checkpoint is None:
        return moment
    path = f"{checkpoint.rstrip('/')}-start"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        row = spark.createDataFrame([(moment.timestamp(),)], "started double")
        row.coalesce(1).write.mode("overwrite").parquet(path)
    return datetime.fromtimestamp(spark.read.parquet(path).first()[0], tz=timezone.utc)


def stream_hourly(trips: DataFrame) -> DataFrame:
    """Trips and revenue per hour of pickup, for a stream or for stored trips.

    In a stream, events more than an hour behind the latest pickup of earlier batches are dropped.
    The result is not sorted: a stream of updates has no order, readers sort.
    """
    if trips.isStreaming:
        # A watermark needs a timestamp with zone; the session's zone maps it back unchanged.
        timed = trips.withColumn("_pickup", F.col(C.PICKUP).cast("timestamp"))
        timed = timed.withWatermark("_pickup", C.HOURLY_WATERMARK)
    else:
        timed = trips.withColumn("_pickup", F.col(C.PICKUP))
    hours = timed.groupBy(F.window("_pickup", C.HOURLY_WINDOW).alias("_window")).agg(
        F.count(F.lit(1)).alias("trip_count"), exact_sum("total_amount").alias("revenue")
    )
    bounds = {"window_start": F.col("_window.start"), "window_end": F.col("_window.end")}
    return hours.select(
        *[bound.cast("timestamp_ntz").alias(name) for name, bound in bounds.items()], "trip_count", "revenue"
    )


_HOURS = "window_start timestamp_ntz, window_end timestamp_ntz, trip_count bigint, revenue double, window_hour string"


def _upsert_hours(path: str):
    """Each batch replaces the hours it updates, so repeating a batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        hour = F.substring(F.col("window_start").cast("string"), 1, 13)
        rows = batch.withColumn("window_hour", F.translate(hour, " ", "T")).repartition("window_hour")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("window_hour").parquet(path)

    return write


def start_hourly(
    hourly: DataFrame,
    path: str | None,
    checkpoint: str | None = None,
    mode: str = "update",
    available_now: bool = False,
) -> StreamingQuery:
    """Start the hourly query; the checkpoint is kept, so a restart goes on where it stopped.

    ``update`` overwrites hours as they change; ``append`` writes an hour once, when it is closed,
    so the latest hours are still to come. Without a path, updates go to the console.
    """
    writer = hourly.writeStream.outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=C.HOURLY_TRIGGER)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if path is None:
        return writer.format("console").option("truncate", "false").start()
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(_upsert_hours(path)).start()


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_HOURS).parquet(path).drop("window_hour").orderBy("window_start")


def run_stream(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for a query; a timeout stops it."""
    try:
        query.awaitTermination(timeout_s)
    finally:
        query.stop()
