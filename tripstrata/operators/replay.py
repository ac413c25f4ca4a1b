"""Choosing trips to replay, when to send each, and the events themselves."""

from __future__ import annotations

import re
import warnings
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.times import micros_between
from ..sources import files
from .gold import max_pickup_date
from .silver import trips_of_day


def _in_order(df: DataFrame) -> list[str]:
    return [C.PICKUP, *[c for c in df.columns if c != C.PICKUP]]


def replay_select(
    silver: DataFrame, day=None, limit: int | None = C.REPLAY_DEFAULT_LIMIT, max_limit: int | None = None
) -> DataFrame:
    """First ``limit`` trips of one day by pickup time; the latest day unless one is given.

    Without a limit the whole day is selected. A caller that serves strangers passes ``max_limit``; a
    larger or missing limit is then cut to it, with a warning. The latest day is read as one value
    first: as a literal it reaches the scan as a range filter.
    """
    if day is None:
        day = max_pickup_date(silver).first()[0]
        if day is None:
            raise ValueError("no Silver trips to replay")
    if max_limit is not None and (limit is None or limit > max_limit):
        warnings.warn(f"replay is cut to {max_limit} trips", stacklevel=2)
        limit = max_limit
    chosen = trips_of_day(silver, day).orderBy(*_in_order(silver))
    return chosen if limit is None else chosen.limit(max(1, int(limit)))


def replay_schedule(
    selected: DataFrame, rate: float | None = C.REPLAY_DEFAULT_RATE, speed: int = 1
) -> DataFrame:
    """Event number and send time at a flat rate, in order of pickup.

    Trips are numbered within their minute; each minute starts where the trips before it end, which
    takes one ordered pass over the minutes, not over the trips.
    """
    if speed not in C.REPLAY_SPEEDS:
        raise ValueError(f"speed must be one of {C.REPLAY_SPEEDS}")
    per_second = max(C.REPLAY_MIN_RATE, min(float(rate or C.REPLAY_DEFAULT_RATE), C.REPLAY_MAX_RATE))
    minute = F.date_trunc("minute", F.col(C.PICKUP)).alias("_minute")
    earlier = Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    starts = selected.groupBy(minute).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("_minute").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_minute").orderBy(*_in_order(selected))) - 1
    numbered = selected.withColumn("_minute", minute).withColumn("_within", within)
    joined = numbered.join(starts, F.col("_minute").eqNullSafe(F.col("_at")))
    number = (F.col("_start") + F.col("_within")).cast("bigint")
    return joined.select(*selected.columns, number.alias("event_number")).withColumn(
        "send_at_s", F.col("event_number") / F.lit(per_second * speed)
    )


def replay_schedule_gap(trips: DataFrame, speed: float = 0) -> DataFrame:
    """Send time that keeps the real gaps, divided by ``speed``; 0 sends without delay.

    Waiting times between sorted pickups add up to the distance from the first one, so a whole day
    needs no ordered pass: one value, the first pickup, is enough.
    """
    if not speed:
        return trips.withColumn("send_at_s", F.lit(0.0))
    first = trips.agg(F.min(C.PICKUP)).first()[0]
    since = trips.withColumn("_first", F.lit(str(first)).cast("timestamp_ntz"))
    return since.withColumn("send_at_s", micros_between(C.PICKUP, "_first") / F.lit(1e6 * speed)).drop("_first")


def replay_gaps(trips: DataFrame, speed: float) -> DataFrame:
    """Wait before each distinct pickup time, and how many trips go out then.

    Trips with the same pickup follow each other at once, so gaps exist between distinct times
    only. Hours are ordered on their own; each takes the last time of the hour before it.
    """
    hour = [F.to_date(C.PICKUP).alias("_day"), F.hour(C.PICKUP).alias("_hour")]
    times = trips.groupBy(C.PICKUP).agg(F.count(F.lit(1)).alias("events")).select("*", *hour)
    earlier_hour = F.lag("_last").over(Window.orderBy("_day", "_hour"))
    hours = (
        times.groupBy("_day", "_hour").agg(F.max(C.PICKUP).alias("_last")).withColumn("_carried", earlier_hour)
    )
    within = Window.partitionBy("_day", "_hour").orderBy(C.PICKUP)
    before = F.coalesce(F.lag(C.PICKUP).over(within), F.col("_carried"))
    waits = times.join(hours.drop("_last"), ["_day", "_hour"]).withColumn("_before", before)
    wait = F.lit(0.0) if not speed else micros_between(C.PICKUP, "_before") / F.lit(1e6 * speed)
    return waits.select(C.PICKUP, "events", F.coalesce(wait, F.lit(0.0)).alias("wait_s"))


def to_events(trips: DataFrame) -> DataFrame:
    """Trips as JSON text in ``value``; missing fields are written as null."""
    clock = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": "false", "timestampNTZFormat": clock, "timestampFormat": clock}
    return trips.select(F.to_json(F.struct(*trips.columns), options).alias("value"))


_STAGED, _MANIFESTS = "_staged", "_manifests"
_MOVES_AT_A_TIME = 16
_EVENTS_PER_FILE = 1_000_000


def content_id(events: DataFrame) -> str:
    """A name of the events that depends on their values and number only, not on order or partitions."""
    low, high = F.xxhash64("value"), F.xxhash64("value", F.lit("publish"))
    # Halves are summed apart, so that no sum overflows.
    halves = [F.sum(F.shiftrightunsigned(h, 32)) for h in (low, high)] + [F.sum(h.bitwiseAND(0xFFFFFFFF)) for h in (low, high)]
    digest = F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]))
    return events.agg(digest.alias("id")).first()["id"]


def stage_publish(events: DataFrame, path: str, publish_id: str, compression: str | None = None) -> None:
    """Write the events beside the topic and, when they are complete, the list of their files.

    Events name every field, so a compressed file is a small part of the plain one; readers take both. As
    one task reads a compressed file whole, such files hold a bounded number of events.
    """
    spark = events.sparkSession
    staged = f"{path}/{_STAGED}/{publish_id}"
    writer = events.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression).option("maxRecordsPerFile", _EVENTS_PER_FILE)
    writer.text(staged)
    names = [name for name in files.children(spark, staged) if not name.startswith(("_", "."))]
    files.write_text(spark, f"{path}/{_MANIFESTS}/{publish_id}", "\n".join(names))


def finish_publish(spark: SparkSession, path: str, publish_id: str) -> None:
    """Move the listed files into the topic; those that an earlier attempt moved are there already."""
    names = [name for name in files.read_text(spark, f"{path}/{_MANIFESTS}/{publish_id}").split("\n") if name]
    present = set(files.children(spark, path))

    def move(name: str) -> None:
        target = f"{publish_id}-{name}"
        if target not in present and not files.rename(spark, f"{path}/{_STAGED}/{publish_id}/{name}", f"{path}/{target}"):
            raise OSError(f"cannot move {name} into {path}")

    with ThreadPool(_MOVES_AT_A_TIME) as pool:
        pool.map(move, names)
    files.write_text(spark, f"{path}/{_MANIFESTS}/{publish_id}.done", "")
    files.delete(spark, f"{path}/{_STAGED}/{publish_id}")


def replay_publish(
    trips: DataFrame,
    path: str | None = None,
    brokers: str | None = None,
    publish_id: str | None = None,
    compression: str | None = None,
) -> str | None:
    """Put the events into a folder that stands for the topic, once, or send them to Kafka.

    A publish has an id, by default one made of the events themselves, and each id enters the topic
    once however often it is published: files appear there only after all of them and their list are
    stored, and an attempt that died is taken up at the list. Give an id of your own to replay the same
    trips again. ``compression`` names a codec for the files, such as gzip. Kafka gives no such promise;
    consumers there see a repeated publish twice.
    """
    events = to_events(trips)
    if brokers:
        events.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", C.TOPIC).save()
        return None
    spark = trips.sparkSession
    publish_id = publish_id or content_id(events)
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", publish_id):
        raise ValueError("a publish id holds letters, digits and hyphens")
    manifest = f"{path}/{_MANIFESTS}/{publish_id}"
    if not files.exists(spark, f"{manifest}.done"):
        if not files.exists(spark, manifest):
            stage_publish(events, path, publish_id, compression)
        finish_publish(spark, path, publish_id)
    return publish_id


def live_projection(trips: DataFrame) -> DataFrame:
    """The ten fields a live view shows."""
    names = {
        C.PICKUP: "pickup_at",
        C.DROPOFF: "dropoff_at",
        C.PICKUP_ZONE: "pu_location_id",
        C.DROPOFF_ZONE: "do_location_id",
        "passenger_count": "passenger_count",
        "trip_distance": "trip_distance",
        "fare_amount": "fare_amount",
        "tip_amount": "tip_amount",
        "total_amount": "total_amount",
        "payment_type": "payment_type",
    }
    return trips.select(*[F.col(name).alias(label) for name, label in names.items()])


def last_n(df: DataFrame, n: int = C.LIVE_TRIPS, by: str = C.PICKUP) -> DataFrame:
    """Newest ``n`` rows first, ties broken by the other columns."""
    others = [F.desc(c) for c in df.columns if c != by]
    return df.orderBy(F.desc(by), *others).limit(n)
