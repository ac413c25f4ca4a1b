"""Two-second totals of arriving trips, empty ticks included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions.fixed_point import merge, parts, total

_MEASURES = {"total": "total_amount", "fare": "fare_amount", "distance": "trip_distance"}
_TICKS_PER_CHUNK = 1800


def tick_parts(events: DataFrame, seconds: int = C.TICK_SECONDS, arrival: str = "arrived_at") -> DataFrame:
    """Additive totals per tick that has events."""
    tick = F.window(arrival, f"{seconds} seconds").start
    totals = [column for name, value in _MEASURES.items() for column in parts(value, name)]
    return events.groupBy(tick.alias("tick_start")).agg(F.count(F.lit(1)).alias("trip_count"), *totals)


def _every_tick(ticks: DataFrame, seconds: int) -> DataFrame:
    """All tick starts between the first and the last, generated in parallel chunks."""
    step, chunk = F.make_dt_interval(secs=F.lit(seconds)), F.make_dt_interval(secs=F.lit(seconds * _TICKS_PER_CHUNK))
    chunks = (
        ticks.agg(F.min("tick_start").alias("_first"), F.max("tick_start").alias("_last"))
        .where(F.col("_first").isNotNull())
        .select(F.explode(F.sequence("_first", "_last", chunk)).alias("_chunk"), "_last")
        .repartition("_chunk")
    )
    end = F.least(F.col("_chunk") + F.make_dt_interval(secs=F.lit(seconds * (_TICKS_PER_CHUNK - 1))), F.col("_last"))
    return chunks.select(F.explode(F.sequence(F.col("_chunk"), end, step)).alias("tick_start"))


def ticks_from_parts(stored: DataFrame, seconds: int = C.TICK_SECONDS) -> DataFrame:
    """One row per tick from the first to the last event; an empty tick is a row of zeros.

    Empty ticks are added as rows and summed with the rest: no join, and one shuffle.
    """
    blank = _every_tick(stored, seconds).withColumn("trip_count", F.lit(0).cast("bigint"))
    summed = (
        stored.unionByName(blank, allowMissingColumns=True)
        .groupBy("tick_start")
        .agg(F.sum("trip_count").alias("trip_count"), *[column for name in _MEASURES for column in merge(name)])
    )
    count = F.col("trip_count")

    def per_trip(name: str) -> Column:
        return F.when(count > 0, F.coalesce(total(name), F.lit(0.0)) / count).otherwise(0.0)

    return summed.select(
        (F.col("tick_start") + F.make_dt_interval(secs=F.lit(seconds))).alias("window_ended_at"),
        "trip_count",
        (count / F.lit(float(seconds))).alias("messages_per_second"),
        F.coalesce(total("total"), F.lit(0.0)).alias("total_revenue"),
        per_trip("fare").alias("avg_fare"),
        per_trip("distance").alias("avg_distance"),
    )


def live_ticks(events: DataFrame, seconds: int = C.TICK_SECONDS, arrival: str = "arrived_at") -> DataFrame:
    return ticks_from_parts(tick_parts(events, seconds, arrival), seconds)


def start_ticks(
    events: DataFrame, path: str, checkpoint: str, seconds: int = C.TICK_SECONDS, available_now: bool = False
) -> StreamingQuery:
    """Store tick totals of each batch of trips, by arrival time unless ``arrived_at`` is given.

    Each batch has its own partition, so a repeated batch replaces itself, and a tick that spans
    two batches is summed when it is read.
    """
    stamped = events if "arrived_at" in events.columns else events.withColumn("arrived_at", F.current_timestamp())

    def write(batch: DataFrame, batch_id: int) -> None:
        tick_parts(batch, seconds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stamped.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def read_ticks(spark: SparkSession, path: str, seconds: int = C.TICK_SECONDS) -> DataFrame:
    return ticks_from_parts(spark.read.parquet(path).drop("batch"), seconds)
