"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Nothing here holds logic of its own beyond wiring operators to the adapters. Columns of type array
or struct are flattened, so that results compare by value.
"""

from __future__ import annotations

import operator
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.adhoc_sql import ADHOC
from tripstrata import constants as C
from tripstrata import schemas
from tripstrata.functions.times import expand_months
from tripstrata.operators import adhoc, dashboards, features, gold, model, profile, replay, runlog, service, silver, trees
from tripstrata.plans import pipeline
from tripstrata.session import shared_dir, stored
from tripstrata.sources import adapters, ingest, lake
from tripstrata.streaming import query_log, ticks, topics, trips, watermarks

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
NOW = "2024-02-01 00:00:00"
DECIMALS = 9
SAMPLE_ROWS = 3_000


def _on_bronze(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(adapters.bronze(spark, sf_dir))


def _on_silver(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(adapters.silver(spark, sf_dir))


def _on_events(adapter: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(adapter(adapters.table(spark, sf_dir, "events")))


def _on_runs(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_events(adapters.run_log, build)


def _on_requests(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_events(adapters.request_log, build)


def _gold_frames(trips_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily, hourly and congestion tables from one stored rollup, so the trips are read once."""
    cells = stored(gold.trip_rollup(trips_), "rollup")
    return gold.daily_revenue(cells), gold.hourly_demand(cells), gold.congestion_metrics(cells)


def _rounded(df: DataFrame, *columns: str, places: int = DECIMALS) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in columns})


# --- Compositions that need more than one step ------------------------------------------------


def _month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = adapters.bronze(spark, sf_dir).agg(F.min("period").alias("start"), F.max("period").alias("end"))
    return expand_months(bounds)


def _flat_report(report: DataFrame) -> DataFrame:
    missing = [F.col(f"missing_value_counts.{c}").alias(f"missing_{c}") for c in C.MONITORED_COLUMNS]
    return report.select(*[c for c in report.columns if c != "missing_value_counts"], *missing)


def _quality_report(bronze: DataFrame) -> DataFrame:
    """Counted from stored rows, as in production: the report reads them three times."""
    return _flat_report(silver.quality_report(stored(bronze, "bronze")))


def _run_gold(trips_: DataFrame) -> DataFrame:
    """Rows and trips of the four Gold tables and the features, all from one stored rollup."""
    cells = stored(gold.trip_rollup(trips_), "rollup")
    built = {name: build(cells) for name, build in gold.BUILDERS.items()}
    built[C.FEATURE_TABLE] = features.zone_hour_features(cells)
    counted = [
        table.agg(F.count(F.lit(1)).alias("table_rows"), F.sum("trip_count").alias("trips")).select(
            F.lit(name).alias("table_name"), "table_rows", "trips"
        )
        for name, table in built.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


def _incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_gold`` over a lake that grew in two steps, with one period wrong at first."""
    root, trips_ = _folder(spark, "rollup"), adapters.silver(spark, sf_dir).withColumn("outcome", F.lit(C.ACCEPTED))
    early, mended = F.col("period") < "1998-01", F.col("period") == "1997-05"
    lake.write_silver(trips_.where(early & (~mended | (F.col("payment_type") == 1))), root)
    pipeline.refresh_rollup(spark, root)
    lake.write_silver(trips_.where(~early | mended), root)
    return _run_gold(pipeline.refresh_rollup(spark, root))


def _day_filter(trips_: DataFrame) -> DataFrame:
    return silver.trips_of_day(trips_, "1996-01-02")


def _feature_lookup(trips_: DataFrame) -> DataFrame:
    """Dropoff zone and hour of every trip as requests: zones without pickups are not found."""
    requests = trips_.select(
        F.col(C.DROPOFF_ZONE).alias(C.PICKUP_ZONE), F.hour(C.PICKUP).alias("pickup_hour"), "payment_type"
    )
    # Stored, so its size is known and the requests stay where they are.
    found = features.feature_lookup(requests, stored(features.zone_hour_features(trips_), "features"))
    return found.groupBy(C.PICKUP_ZONE, "pickup_hour", "found").agg(
        F.count(F.lit(1)).alias("requests"),
        F.max("trip_count").alias("trip_count"),
        F.max("avg_fare").alias("avg_fare"),
        F.max("avg_tip").alias("avg_tip"),
    )


def _replay_flat(trips_: DataFrame) -> DataFrame:
    selected = replay.replay_select(trips_, limit=C.REPLAY_MAX_LIMIT)
    return replay.replay_schedule(selected, rate=20.0, speed=2)


def _replay_gap(trips_: DataFrame) -> DataFrame:
    scheduled = replay.replay_schedule_gap(trips_, speed=3600.0)
    return scheduled.select(C.PICKUP, C.DROPOFF, C.PICKUP_ZONE, "total_amount", "send_at_s")


def _skip_malformed(trips_: DataFrame) -> DataFrame:
    """Trips to JSON and back; events of some zones are damaged on the way and must be skipped."""
    text = F.col("value")
    text = F.regexp_replace(text, r'"PULocationID":(\d*1),', '"PULocationID" $1,')
    text = F.regexp_replace(text, r'"PULocationID":\d*2,', '"PULocationID":"x",')
    decoded = trips.decode_trips(replay.to_events(trips_.drop("period")).select(text.alias("value")))
    return decoded.groupBy(C.PICKUP_ZONE).agg(
        F.count(F.lit(1)).alias("trips"),
        F.min(C.PICKUP).alias("first_pickup"),
        F.max("total_amount").alias("max_total"),
        F.count("passenger_count").alias("known_passengers"),
    )


def _digest(every_tick: DataFrame) -> DataFrame:
    """All ticks, empty ones included, digested per hour."""
    started = every_tick.withColumn("tick_start", F.col("window_ended_at") - F.expr("interval 2 seconds"))
    return started.groupBy(F.window("tick_start", "1 hour").start.alias("tick_hour")).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count_if(F.col("trip_count") == 0).alias("empty_ticks"),
        F.sum("trip_count").alias("trips"),
        F.max("messages_per_second").alias("max_rate"),
        F.max("total_revenue").alias("max_revenue"),
        F.max("avg_fare").alias("max_avg_fare"),
        F.max("avg_distance").alias("max_avg_distance"),
    )


def _live_tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digest from a streaming query over the events, stored and read back."""
    folder = f"{shared_dir(spark)}/tick-stream-{uuid.uuid4().hex}"
    schema = adapters.table(spark, sf_dir, "events").schema
    # A pattern, because a stream takes a plain path for a folder.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    query = ticks.start_ticks(adapters.arrivals(events), f"{folder}/ticks", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return _digest(ticks.read_ticks(spark, f"{folder}/ticks"))


def _live_feed(trips_: DataFrame) -> DataFrame:
    return replay.last_n(replay.live_projection(trips_), C.LIVE_TRIPS, "pickup_at")


def _live_tick_history(arrivals: DataFrame) -> DataFrame:
    return replay.last_n(ticks.live_ticks(arrivals), C.LIVE_TICKS, "window_ended_at")


def _regression_metrics(trips_: DataFrame) -> DataFrame:
    """Metrics of a fixed linear guess, so that the formula is checked, not a model."""
    rows = model.training_rows(trips_)
    scored = rows.withColumn("prediction", F.col("trip_distance") * 8 + F.col("passenger_count"))
    return _rounded(model.regression_metrics(scored), "mae", "rmse", "r2", places=6)


_fitted: dict[tuple[str, str], tuple] = {}


def _trained(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        _fitted[key] = model.train_fare_model(stored(adapters.silver(spark, sf_dir), "accepted"))
    return _fitted[key]


def _train_fare_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, result = _trained(spark, sf_dir)
    return spark.createDataFrame([result], "mae double, rmse double, r2 double, rows bigint")


def _score_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, _ = _trained(spark, sf_dir)
    scored = model.score_fares(fitted, adapters.silver(spark, sf_dir), decimals=2)
    return scored.select(*C.MODEL_FEATURES, C.MODEL_TARGET, "predicted_fare")


def _logged_model(spark: SparkSession, sf_dir: str, runs: int = 1) -> str:
    """A folder in which the fitted model was logged; of several runs the latest is logged first."""
    fitted, result = _trained(spark, sf_dir)
    root = _folder(spark, "models")
    for age in reversed(range(runs)):
        started = result["started_at"] - timedelta(hours=runs - 1 - age)
        model.log_run(spark, root, fitted, {**result, "started_at": started, "rows": result["rows"] + age})
    return root


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of features of the accepted trips, with what the stored nodes say and whether the model
    gives exactly that for each of the trips."""
    root = _logged_model(spark, sf_dir)
    columns = [*C.MODEL_FEATURES, C.MODEL_TARGET]
    rows = stored(model.with_pickup_hour(adapters.silver(spark, sf_dir)).select(*columns), "features")
    walked = trees.walk(model.latest_nodes(spark, root), rows)
    scored = model.score_fares(model.latest_model(spark, root), rows).groupBy(*C.MODEL_FEATURES)
    spread = scored.agg(F.min("predicted_fare").alias("low"), F.max("predicted_fare").alias("high"))
    named = spread.select(*(F.col(c).alias(f"m_{c}") for c in C.MODEL_FEATURES), "low", "high")
    same = reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in C.MODEL_FEATURES))
    agrees = (F.col("prediction") == F.col("low")) & (F.col("prediction") == F.col("high"))
    return walked.join(named, same, "left").select(
        *C.MODEL_FEATURES, F.col("rows").alias("trips"), F.coalesce(agrees, F.lit(False)).alias("agrees")
    )


def _fare_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model on the same trips, at a fare that follows the distance and a surcharge by hour, so that
    there is something to learn."""
    fare = F.lit(3.0) + F.col("trip_distance") * 2.5 + F.hour(C.PICKUP) % 3
    trips_ = stored(adapters.silver(spark, sf_dir).withColumn("fare_amount", fare), "accepted")
    _, result = model.train_fare_model(trips_)
    learned = result["r2"] > 0.85 and result["mae"] <= result["rmse"]
    return spark.createDataFrame([(result["rows"], learned)], "rows bigint, learned boolean")


def _log_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two runs of a log, the models they point to, and their tables of nodes."""
    root = _logged_model(spark, sf_dir, runs=2)
    runs = spark.read.schema(schemas.MODEL_RUNS).parquet(f"{root}/model_runs")
    nodes = spark.read.parquet(f"{root}/model_nodes").groupBy("run_id").agg(
        F.count_distinct("tree").alias("trees"),
        F.sum(F.when(F.col("node") == 0, 1)).alias("roots"),
        # In a binary tree there is one leaf more than inner nodes.
        F.sum(F.when(F.col("left").isNull(), 1).otherwise(-1)).alias("leaves_over"),
    )
    return runs.join(nodes, "run_id").select(
        "rows",
        F.get_json_object("params", "$.trees").cast("bigint").alias("trees_asked"),
        F.get_json_object("params", "$.features").alias("features"),
        F.get_json_object("metrics", "$.mae").isNotNull().alias("has_mae"),
        *("trees", "roots", "leaves_over"),
    )


def _latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three runs, logged out of order, is the latest, and how many trips its model scores."""
    root = _logged_model(spark, sf_dir, runs=3)
    scored = model.score_fares(model.latest_model(spark, root), adapters.silver(spark, sf_dir))
    return scored.agg(
        F.lit(model.latest_run(spark, root)["rows"]).cast("bigint").alias("trained_on"),
        F.count("predicted_fare").alias("scored"),
    )


def _split(trips_: DataFrame) -> DataFrame:
    train, test = model.train_test_split(stored(model.training_rows(trips_), "training"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _latest_kpis(trips_: DataFrame) -> DataFrame:
    return dashboards.latest_kpis(*_gold_frames(trips_))


def _dashboard_totals(trips_: DataFrame) -> DataFrame:
    return dashboards.dashboard_totals(*_gold_frames(trips_))


def _describe(bronze: DataFrame) -> DataFrame:
    return _rounded(profile.profile_describe(bronze), "mean", "std", "p25", "p50", "p75", places=6)


def _online(trips_: DataFrame) -> DataFrame:
    return features.publish_online(features.zone_hour_features(trips_))


def _table_files(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {name: [f"{sf_dir}/{name}.parquet"] for name in TABLES}


def _storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and rows of each table; bytes have no SQL twin, so only their presence is compared."""
    stats = lake.storage_stats(spark, _table_files(spark, sf_dir))
    return stats.select("layer", "file_count", "total_rows", (F.col("bytes_per_row") > 0).alias("has_bytes"))


def _lake_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lake.lake_inventory(spark, _table_files(spark, sf_dir))
    ordered = F.col("oldest") <= F.col("newest")
    return found.select("layer", "object_count", (F.col("total_bytes") > 0).alias("has_bytes"), ordered.alias("ordered"))


# --- Round trips: written by one function, read back by another --------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "silver")
    lake.write_silver(silver.with_outcome(adapters.bronze(spark, sf_dir)), root)
    return lake.load_silver(spark, root)


def _write_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "quarantine")
    lake.write_quarantine(silver.with_outcome(adapters.bronze(spark, sf_dir)), root)
    return lake.load_quarantine(spark, root).withColumnRenamed("rule", "category")


def _write_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "report")
    lake.write_quality_report(silver.quality_report(stored(adapters.bronze(spark, sf_dir), "bronze")), root)
    return _flat_report(lake.read_quality_report(spark, root))


def _gold_round_trip(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _folder(spark, "gold")
        lake.write_gold(gold.BUILDERS[name](adapters.silver(spark, sf_dir)), root, name)
        return lake.read_gold(spark, root, name)

    return run


def _publish_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two publishes, while a reader asks for it all the time: it must always be there, whole."""
    name = f"published_{uuid.uuid4().hex}"
    table = stored(gold.daily_revenue(adapters.silver(spark, sf_dir)), "daily")
    lake.publish_table(table, name, grain=["pickup_date"])
    rows, done, seen = table.count(), threading.Event(), []

    def read() -> None:
        while not done.is_set():
            seen.append(spark.table(name).count())

    with ThreadPool(1) as pool:
        reading = pool.apply_async(read)
        try:
            for _ in range(2):
                lake.publish_table(table, name, grain=["pickup_date"], keep=3)
        finally:
            done.set()
        reading.get()
    if set(seen) - {rows}:
        raise RuntimeError(f"a reader saw {set(seen)} rows of {rows}")
    return spark.table(name)


def _export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = _folder(spark, "csv"), gold.daily_revenue(adapters.silver(spark, sf_dir))
    lake.export_csv(table, path)
    return spark.read.schema(table.schema).option("header", "true").csv(path)


def _ingest_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing files through the gate into Bronze, and read back."""
    base = _folder(spark, "ingest")
    landing = f"{base}/landing"
    adapters.bronze(spark, sf_dir).repartition("period").write.partitionBy("period").parquet(landing)
    ingest.ingest_bronze(spark, landing, base)
    return lake.load_bronze(spark, base)


def _schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the periods of a landing folder: in some months a column is missing, in some it has another type."""
    base, rows = _folder(spark, "gate"), stored(adapters.bronze(spark, sf_dir), "bronze")
    month = F.substring("period", 6, 2).cast("int")
    kinds = {
        0: rows.drop("extra", "RatecodeID"),
        1: rows.withColumn("VendorID", F.col("VendorID").cast("bigint")).withColumn("extra", F.col("extra").cast("string")),
        2: rows.withColumn("one_more", F.lit("x")),
    }
    for kind, made in kinds.items():
        made.where(month % 3 == kind).repartition("period").write.mode("append").partitionBy("period").parquet(f"{base}/landing")
    return ingest.ingest_bronze(spark, f"{base}/landing", base).select("period", "status", "reason", "rows")


def _to_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted trips, stored: a publish reads them for its id and again for its files."""
    return stored(adapters.silver(spark, sf_dir).drop("period"), "accepted")


def _stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips published to a topic folder, streamed, and the closed hours read from the sink."""
    base = _folder(spark, "stream")
    replay.replay_publish(_to_publish(spark, sf_dir), f"{base}/topic", compression="gzip")
    hourly = trips.stream_hourly(trips.stream_trips(spark, f"{base}/topic"))
    query = trips.start_hourly(hourly, f"{base}/hours", f"{base}/checkpoint", "append", available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/hours")


def _replay_day(trips_: DataFrame) -> DataFrame:
    """All trips moved to one day, selected without a limit and scheduled."""
    clock = F.expr(f"timestamp_ntz'2024-01-05' + ({C.PICKUP} - date_trunc('day', {C.PICKUP}))")
    # Numbering reads the day twice, and sorting it once more.
    one_day = stored(trips_.withColumn(C.PICKUP, clock.cast("timestamp_ntz")), "day")
    scheduled = replay.replay_schedule(replay.replay_select(one_day, "2024-01-05", None), rate=100.0, speed=10)
    return scheduled.select(C.PICKUP, C.DROPOFF, C.PICKUP_ZONE, "total_amount", "event_number", "send_at_s")


def _cut(first: bool):
    before = F.col(C.PICKUP) < F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    return before if first else ~before


def _streamed(spark: SparkSession, base: str, **options) -> DataFrame:
    """All trips of a topic as a stream reads and stores them; another run goes on where the last one ended."""
    query = (
        trips.stream_trips(spark, f"{base}/topic", **options)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/trips")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/trips")


def _offsets_and_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishes, a run after each. The query's own log has to give every file to one committed batch,
    and the sink has to hold the trips of both."""
    base, source = _folder(spark, "stopped"), _to_publish(spark, sf_dir)
    for name, first in (("first", True), ("second", False)):
        replay.replay_publish(source.where(_cut(first)), f"{base}/topic", publish_id=name, compression="gzip")
        sink = _streamed(spark, base)
    path = query_log.path_key(F.col("_metadata.file_path")).alias("file")
    read = spark.read.text(f"{base}/topic").groupBy(path).agg(F.count(F.lit(1)).alias("trips"))
    audit = query_log.audit_files(spark, f"{base}/checkpoint", f"{base}/topic").join(read, "file", "left")
    publish = F.regexp_extract("file", r"/(first|second)-[^/]*$", 1)
    logged = audit.groupBy(publish.alias("publish")).agg(
        F.coalesce(F.sum(F.when(F.col("committed_batches") == 1, F.col("trips"))), F.lit(0)).alias("trips"),
        F.count_if((F.col("committed_batches") == 0) | ~F.col("in_topic")).alias("files_lost"),
        F.count_if(F.col("batches") > 1).alias("files_repeated"),
    )
    stored_trips = sink.groupBy(F.when(_cut(True), "first").otherwise("second").alias("publish")).agg(
        F.count(F.lit(1)).alias("trips_in_sink")
    )
    return logged.join(stored_trips, "publish", "left").select(
        "publish", "trips", "trips_in_sink", "files_lost", "files_repeated"
    )


def _tail_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of a stream that starts at the end of the topic: the backlog of the first publish is skipped,
    and what arrives while the query is stopped is not."""
    base, source = _folder(spark, "tail"), _to_publish(spark, sf_dir)
    replay.replay_publish(source.where(_cut(True)), f"{base}/topic", publish_id="first", compression="gzip")
    backlog = spark.read.format("binaryFile").load(f"{base}/topic").agg(F.max("modificationTime")).first()[0]
    since = (backlog or datetime(2000, 1, 1)).astimezone() + timedelta(milliseconds=1)
    options = {"starting_offsets": "latest", "since": since, "checkpoint": f"{base}/checkpoint"}
    _streamed(spark, base, **options)
    replay.replay_publish(source.where(_cut(False)), f"{base}/topic", publish_id="second", compression="gzip")
    return _streamed(spark, base, **options)


def _stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "source")
    replay.replay_publish(_to_publish(spark, sf_dir), f"{base}/topic", compression="gzip")
    return _streamed(spark, base)


def _replay_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of a topic by zone, after an attempt that died before it moved a file and two more publishes."""
    base, source = _folder(spark, "publish"), _to_publish(spark, sf_dir)
    events = replay.to_events(source)
    replay.stage_publish(events, f"{base}/topic", replay.content_id(events), compression="gzip")
    for _ in range(2):
        replay.replay_publish(source, f"{base}/topic", compression="gzip")
    return _streamed(spark, base).groupBy(C.PICKUP_ZONE).agg(
        F.count(F.lit(1)).alias("trips"), F.min(C.PICKUP).alias("first_pickup"), F.max("total_amount").alias("max_total")
    )


def _late_data(events: DataFrame) -> DataFrame:
    """Events dealt into batches by id, some of them held back by hundreds of events."""
    held = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 7 * 100).otherwise(0)
    dealt = events.withColumn("batch", F.floor((F.col("event_id") + held) / 50))
    return watermarks.late_data(dealt, event_time="ts")


def _sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on texts made of every event: eight forms, filled with the event's type and user."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    forms = (
        F.lit(" "),
        F.concat(F.lit("select * from events where event_type = '"), kind, F.lit("' and user_id = "), user),
        F.concat(F.lit("SELECT "), user, F.lit(";")),
        F.concat(F.lit("with x as (select "), user, F.lit(") select * from x")),
        F.concat(F.lit("delete from events where user_id = "), user),
        F.concat(F.lit("-- select "), user),
        F.concat(F.lit("select 1; select "), user),
        F.concat(F.lit("select ';' as "), kind),
    )
    form = F.col("event_id") % len(forms)
    text = F.coalesce(*[F.when(form == number, made) for number, made in enumerate(forms)])
    texts = adapters.table(spark, sf_dir, "events").select(form.alias("form"), kind, text.alias("text"))
    # Each distinct text is judged once.
    distinct = texts.groupBy("form", "event_type", "text").agg(F.count(F.lit(1)).alias("n"))
    judged = distinct.withColumn("reason", adhoc.guard_reason(F.col("text")))
    return judged.groupBy("form", "event_type", "reason").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("events"))


def _read_only_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ad-hoc SQL counts in a stored copy of the events after several attempts to change it."""
    _with_views(spark, sf_dir)
    name = f"guarded_{uuid.uuid4().hex}"
    adapters.table(spark, sf_dir, "events").write.saveAsTable(name)
    attempts = (
        f"INSERT INTO {name} SELECT * FROM events",
        f"WITH x AS (SELECT * FROM events) INSERT INTO {name} SELECT * FROM x",
        f"SELECT * FROM {name}; DROP TABLE {name}",
        f"select 1) ; TRUNCATE TABLE {name} --",
        f"DROP TABLE {name}",
    )
    refused = sum(adhoc.run_sql(spark, text).error is not None for text in attempts)
    asked = f"SELECT event_type, COUNT(*) AS events FROM {name} GROUP BY event_type"
    return adhoc.read_only(spark, asked).withColumn("refused", F.lit(refused).cast("bigint"))


def _published_gold(spark: SparkSession, trips_: DataFrame) -> str:
    """A new database with the four Gold tables; its name."""
    database = f"gold_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    cells = stored(gold.trip_rollup(trips_), "rollup")
    for name, build in gold.BUILDERS.items():
        lake.publish_table(build(cells), f"{database}.{name}")
    return database


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _published_gold(spark, adapters.silver(spark, sf_dir))
    return adhoc.catalog(spark, [database, "no_such_database"]).drop("table_schema")


def _table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each published table and of its preview, whose rows have to be rows of the table."""
    database, rows = _published_gold(spark, adapters.silver(spark, sf_dir)), []
    for name in (*C.GOLD_TABLES, "no_such_table"):
        shown = adhoc.table_preview(spark, database, name)
        if shown.sample is None:
            rows.append((name, shown.row_count, None, None, True))
            continue
        table = spark.table(f"{database}.{name}")
        sample = spark.createDataFrame(shown.sample.rows, table.schema)
        strange = sample.exceptAll(table).count()
        rows.append((name, shown.row_count, len(shown.sample.rows), strange, False))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, sampled bigint, strange bigint, failed boolean")


def _reset_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reset finds in a lake and a database made for it; a second reset has to find nothing."""
    base = _folder(spark, "reset")
    adapters.bronze(spark, sf_dir).repartition("period").write.partitionBy("period").parquet(f"{base}/landing")
    ingest.ingest_bronze(spark, f"{base}/landing", f"{base}/lake")
    pipeline.run_silver(spark, f"{base}/lake")
    database = _published_gold(spark, lake.load_silver(spark, f"{base}/lake"))
    first = lake.reset_layers(spark, f"{base}/lake", database)
    again = lake.reset_layers(spark, f"{base}/lake", database).agg(F.sum("removed")).first()[0]
    rows = first.where("kind = 'table'").select("name", "removed")
    periods = first.where("kind = 'folder' AND name = 'bronze'").select("name", (F.col("removed") > 0).cast("bigint"))
    return rows.union(periods).withColumn("left_over", F.lit(again).cast("bigint"))


def _bundle(frames: dict[str, DataFrame]) -> DataFrame:
    """Each dataset of a bundle with its rows and columns, in one table."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(frame.columns)).cast("bigint").alias("columns")).withColumn(
            "dataset", F.lit(name)
        )
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def _dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stored(gold.trip_rollup(adapters.silver(spark, sf_dir)), "rollup")
    runs_ = adapters.run_log(adapters.table(spark, sf_dir, "events"))
    tables = {name: build(cells) for name, build in gold.BUILDERS.items()}
    return _bundle(dashboards.dashboard_overview(tables, runs_))


def _home_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home page's figures as rows of name and value."""
    daily = gold.daily_revenue(adapters.silver(spark, sf_dir))
    stats = dashboards.home_stats(daily, adapters.run_log(adapters.table(spark, sf_dir, "events")))
    trend = stats.pop("revenue_trend").select(
        F.concat(F.lit("revenue_trend "), F.col("pickup_date").cast("string")).alias("figure"),
        F.round("total_revenue", 6).alias("value"),
    )
    single = [
        frame.select(F.lit(name).alias("figure"), F.col(frame.columns[0]).cast("double").alias("value"))
        for name, frame in stats.items()
    ]
    return reduce(DataFrame.unionByName, single, trend)


def _with_views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        adapters.table(spark, sf_dir, name).createOrReplaceTempView(name)


def _adhoc(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _with_views(spark, sf_dir)
        return adhoc.read_only(spark, text)

    return run


def _run_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows an ad-hoc query hands to its caller: the first 500, as the row limit says."""
    _with_views(spark, sf_dir)
    text = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey"
    result = adhoc.run_sql(spark, text)
    if result.error:
        raise RuntimeError(result.error)
    rows = [(*row, result.truncated) for row in result.rows]
    return spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, truncated boolean")


def _rules() -> dict[str, Query]:
    return {name: _on_bronze(lambda rows, rule=rule: rows.where(rule())) for name, rule in silver.RULES.items()}


QUERIES: dict[str, Query] = {
    # Sources and sinks
    "list_periods": _on_bronze(lake.periods_of),
    "month_range": _month_range,
    "ingest_rollup": lambda spark, sf_dir: ingest.ingest_rollup(
        adapters.ingest_results(adapters.bronze(spark, sf_dir))
    ),
    "load_silver": _on_silver(lambda rows: rows),
    "publish_online": _on_silver(_online),
    "lake_inventory": _lake_inventory,
    "storage_stats": _storage_stats,
    # Round trips
    "ingest_bronze": _ingest_bronze,
    "schema_gate": _schema_gate,
    "write_silver": _write_silver,
    "write_quarantine": _write_quarantine,
    "write_quality_report": _write_quality_report,
    "write_gold": _gold_round_trip("hourly_demand"),
    "read_gold": _gold_round_trip("daily_revenue"),
    "publish_table": _publish_table,
    "export_csv": _export_csv,
    "stream_sink": _stream_sink,
    "stream_source": _stream_source,
    "replay_publish": _replay_publish,
    "reset_layers": _reset_layers,
    # Silver rules
    **_rules(),
    "monitor_nulls": _on_bronze(silver.monitor_nulls),
    "rule_priority": _on_bronze(
        lambda rows: silver.with_category(rows).groupBy("period", "category").agg(F.count(F.lit(1)).alias("rows"))
    ),
    "silver_accepted": _on_bronze(silver.silver_accepted),
    "quarantine_rows": _on_bronze(silver.quarantine_rows),
    "reject_split": _on_bronze(
        lambda rows: silver.with_tier(rows).groupBy("period", "category", "tier").agg(F.count(F.lit(1)).alias("rows"))
    ),
    "exclude_year_mismatch": _on_silver(silver.exclude_year_mismatch),
    "has_congestion": _on_silver(
        lambda rows: rows.groupBy("congestion_surcharge", silver.has_congestion().alias("has_congestion")).agg(
            F.count(F.lit(1)).alias("rows")
        )
    ),
    "day_filter": _on_silver(_day_filter),
    "drop_incomplete": _on_silver(model.training_rows),
    "prototype_silver": _on_bronze(silver.prototype_silver),
    "prototype_quarantine": _on_bronze(silver.prototype_quarantine),
    "prototype_report": _on_bronze(silver.prototype_report),
    "live_projection": _on_silver(replay.live_projection),
    # Aggregations
    "quality_report": _on_bronze(_quality_report),
    "duplicate_count": _on_bronze(lambda rows: silver.duplicate_count(stored(rows, "bronze"))),
    "daily_revenue": _on_silver(gold.daily_revenue),
    "hourly_demand": _on_silver(gold.hourly_demand),
    "zone_stats": _on_silver(gold.zone_stats),
    "zone_stats_dropoff": _on_silver(lambda rows: gold.zone_stats(rows, C.DROPOFF_ZONE)),
    "congestion_metrics": _on_silver(gold.congestion_metrics),
    "run_gold": _on_silver(_run_gold),
    "incremental_rollup": _incremental_rollup,
    "zone_hour_features": _on_silver(features.zone_hour_features),
    "max_pickup_date": _on_silver(gold.max_pickup_date),
    "dashboard_totals": _on_silver(_dashboard_totals),
    # Sorts, limits, top-k
    "top_zones": _on_silver(lambda rows: dashboards.top_zones(gold.zone_stats(rows))),
    "revenue_last_14": _on_silver(lambda rows: dashboards.revenue_last(gold.daily_revenue(rows))),
    "revenue_change_pct": _on_silver(lambda rows: dashboards.revenue_change(gold.daily_revenue(rows))),
    "latest_daily_kpis": _on_silver(_latest_kpis),
    "replay_select": _on_silver(replay.replay_select),
    "replay_schedule_flat": _on_silver(_replay_flat),
    "replay_schedule_gap": _on_silver(_replay_gap),
    "replay_day": _on_silver(_replay_day),
    "replay_gaps": _on_silver(lambda rows: replay.replay_gaps(rows, 3600.0)),
    "gold_ordering": _on_silver(
        lambda rows: gold.hourly_demand(gold.trip_rollup(rows)).orderBy(*gold.gold_order("hourly_demand"))
    ),
    "live_feed_last_n": _on_silver(_live_feed),
    "live_tick_history": _on_events(adapters.arrivals, _live_tick_history),
    # Streams, as their batch twins
    "stream_hourly": _on_silver(trips.stream_hourly),
    "live_tick": _on_events(adapters.arrivals, lambda rows: _digest(ticks.live_ticks(rows))),
    "live_tick_stream": _live_tick_stream,
    "skip_malformed": _on_silver(_skip_malformed),
    "topic_stats": _on_events(adapters.topic_offsets, topics.topic_stats),
    "late_data": lambda spark, sf_dir: _late_data(adapters.table(spark, sf_dir, "events")),
    "offsets_and_stop": _offsets_and_stop,
    "tail_latest": _tail_latest,
    # Model
    "bounded_sample": _on_silver(
        lambda rows: model.bounded_sample(stored(model.training_rows(rows), "training"), SAMPLE_ROWS)
    ),
    "train_test_split": _on_silver(_split),
    "train_fare_model": _train_fare_model,
    "regression_metrics": _on_silver(_regression_metrics),
    "train_fare_model_signal": _fare_by_distance,
    "score_fares": _score_fares,
    "score_fares_walk": _walked,
    "log_run": _log_run,
    "latest_model": _latest_model,
    "feature_lookup": _on_silver(_feature_lookup),
    # Profiling
    "profile_shape": _on_bronze(profile.profile_shape),
    "profile_preview": _on_bronze(profile.profile_preview),
    "profile_describe": _on_bronze(_describe),
    "profile_nulls": _on_bronze(profile.profile_nulls),
    "profile_rule_counts": _on_bronze(profile.profile_rule_counts),
    "profile_quantiles": _on_bronze(lambda rows: _rounded(profile.profile_quantiles(rows), "p95", "p99", "p999")),
    "profile_ranges": _on_bronze(profile.profile_ranges),
    # Run log
    "etl_health": _on_runs(runlog.etl_health),
    "etl_health_share": _on_runs(lambda runs: runlog.etl_health_share(runlog.etl_health(runs))),
    "train_metrics": _on_runs(runlog.train_metrics),
    "latest_silver_rows": _on_runs(runlog.latest_silver_rows),
    "latest_fare_mae": _on_runs(runlog.latest_fare_mae),
    "months_ingested": _on_runs(runlog.months_ingested),
    "list_runs": _on_runs(lambda runs: runlog.list_runs(runs, C.RUNS_PAGE, 40)),
    "get_run": _on_runs(lambda runs: runlog.get_run(runs, "4711")),
    "latest_run_per_type": _on_runs(runlog.latest_run_per_type),
    "run_status_signal": _on_runs(lambda runs: runlog.with_signal(runs).select("id", "status", "signal", "lineage_signal")),
    "run_duration": _on_runs(lambda runs: runlog.with_duration(runs, NOW).select("id", "status", "duration_seconds")),
    "clear_terminal_runs": _on_runs(runlog.clear_terminal_runs),
    # Service metrics
    "svc_requests_5m": _on_requests(service.svc_requests_5m),
    "svc_error_rate": _on_requests(service.svc_error_rate),
    "svc_rate_by_handler": _on_requests(service.svc_rate_by_handler),
    "svc_rate_by_status": _on_requests(service.svc_rate_by_status),
    "svc_latency_percentiles": _on_requests(
        lambda log: _rounded(service.svc_latency_percentiles(log), "p50", "p95", "p99")
    ),
    "svc_p95_by_handler": _on_requests(lambda log: _rounded(service.svc_p95_by_handler(log), "p95")),
    # Ad-hoc SQL
    "run_sql": _run_sql,
    "sql_guard": _sql_guard,
    "read_only_enforced": _read_only_enforced,
    "catalog": _catalog,
    "table_preview": _table_preview,
    # Bundles
    "dashboard_overview": _dashboard_overview,
    "home_stats": _home_stats,
    **{name: _adhoc(text) for name, text in ADHOC.items()},
}
