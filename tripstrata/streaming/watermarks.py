"""What a watermark does to late events, worked out over stored batches.

A stream judges an event by the watermark that stood before its batch. With the number of the batch
beside each event that judgement can be repeated over a table, at any scale, and explained: which
events came too late, by how much, and which hours lost them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C

_BATCHES_PER_CHUNK = 4096


def prefix_max(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the maximum of ``value`` over all rows of a smaller ``order`` (distinct whole numbers).

    Chunks of consecutive numbers are ordered on their own, and each takes what stood before it from
    the maxima of the chunks, so no task orders more than a chunk or the list of chunks.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(_BATCHES_PER_CHUNK)))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunked.groupBy("_chunk").agg(F.max(value).alias("_top")).select(
        "_chunk", F.max("_top").over(before).alias("_carried")
    )
    within = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("_within", F.max(value).over(within)).join(carried, "_chunk")
    return placed.select(*df.columns, F.greatest("_within", "_carried").alias(name))


def batch_watermarks(
    events: DataFrame, batch: str = "batch", event_time: str = C.PICKUP, delay: str = C.HOURLY_WATERMARK, lag: int = 1
) -> DataFrame:
    """``(batch, latest, watermark)``: the latest event of each batch, and the watermark its events meet.

    The watermark is the latest event of all batches up to ``lag`` + 1 before, in whole milliseconds as
    streams keep it, less the delay; null until there is one. A batch sets the watermark with which
    the next one closes windows; late events are judged one batch later still, which is ``lag`` 1.
    """
    tops = events.where(F.col(batch).isNotNull()).groupBy(F.col(batch).alias("batch")).agg(
        F.max(event_time).alias("latest")
    )
    # Batches without events advance nothing, so the batch before is the one of the next smaller number.
    numbered = prefix_max(tops.withColumn("latest_ms", F.date_trunc("millisecond", "latest")), "batch", "latest_ms", "_seen")
    for _ in range(lag):
        numbered = _of_batch_before(numbered)
    return numbered.select(
        "batch", "latest", (F.col("_seen") - F.expr(f"interval {delay}")).alias("watermark")
    )


def _of_batch_before(batches: DataFrame) -> DataFrame:
    """Each batch with the ``_seen`` of the batch before it."""
    chunked = batches.withColumn("_chunk", F.floor(F.col("batch") / F.lit(_BATCHES_PER_CHUNK)))
    ends = chunked.groupBy("_chunk").agg(F.max_by("_seen", "batch").alias("_last"))
    carried = ends.select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_carried"))
    ordered = Window.partitionBy("_chunk").orderBy("batch")
    placed = chunked.withColumns({"_within": F.lag("_seen").over(ordered), "_first": F.row_number().over(ordered) == 1})
    seen = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_within"))
    return placed.join(carried, "_chunk").select(*[c for c in batches.columns if c != "_seen"], seen.alias("_seen"))


def judged(
    events: DataFrame,
    batch: str = "batch",
    event_time: str = C.PICKUP,
    delay: str = C.HOURLY_WATERMARK,
    window: str = C.HOURLY_WINDOW,
) -> DataFrame:
    """``events`` with ``window_start``, ``window_end``, ``watermark`` and ``late``.

    An event is late when its whole window lies at or before the watermark: a window still open takes
    events older than the watermark. Events without batch or time belong to no window: their columns
    are null and they are not late. The watermarks are a row for each batch and are joined by its number.
    """
    marks = batch_watermarks(events, batch, event_time, delay).select(F.col("batch").alias("_batch"), "watermark")
    marked = events.join(marks, F.col(batch) == F.col("_batch"), "left").drop("_batch")
    bounded = marked.withColumn("window_start", _window_start(event_time, window))
    bounded = bounded.withColumn("window_end", F.col("window_start") + F.expr(f"interval {window}"))
    late = F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False))
    return bounded.withColumn("late", late)


def _window_start(event_time: str, window: str):
    """Start of the tumbling window, counted from the epoch as windows are."""
    since = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(event_time).cast("timestamp_ntz"))
    length = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp_ntz'1970-01-01' + interval {window})")
    into = F.pmod(since, length)
    return F.col(event_time) - F.make_dt_interval(secs=(into / F.lit(1_000_000)).cast("decimal(18,6)"))


def late_data(
    events: DataFrame,
    batch: str = "batch",
    event_time: str = C.PICKUP,
    delay: str = C.HOURLY_WATERMARK,
    window: str = C.HOURLY_WINDOW,
) -> DataFrame:
    """Per window: events accepted and dropped, batches that lost some, and the worst lateness in seconds."""
    rows = judged(events, batch, event_time, delay, window).where(F.col("window_start").isNotNull())
    behind = F.timestamp_diff("SECOND", F.col(event_time), F.col("watermark"))
    return rows.groupBy("window_start", "window_end").agg(
        F.count_if(~F.col("late")).alias("accepted"),
        F.count_if("late").alias("dropped"),
        F.count_distinct(F.when(F.col("late"), F.col(batch))).alias("losing_batches"),
        F.max(F.when(F.col("late"), behind)).alias("worst_lateness_s"),
    )
