"""Watermarks over stored batches, and a query's own log, against real streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import drain, event, late_files, put
from tripstrata import constants as C
from tripstrata.streaming import query_log, trips, watermarks


def batches(spark, *groups):
    rows = [(n, datetime.fromisoformat(f"2024-01-05T{clock}")) for n, clocks in enumerate(groups) for clock in clocks]
    return spark.createDataFrame(rows, f"batch int, {C.PICKUP} timestamp_ntz")


def test_dropped_events_equal_a_real_stream(spark, tmp_path):
    groups = [
        ["00:10:00", "05:10:00"],
        ["05:15:00", "00:50:00", "03:59:59"],
        ["00:20:00", "05:30:00", "04:00:00"],
        ["09:00:00", "04:59:59.999"],
        ["05:00:00", "03:00:00", "07:30:00"],
        ["05:59:00", "08:00:00"],
    ]
    for n, clocks in enumerate(groups):
        put(f"{tmp_path}/topic", f"{n}.json", *map(event, clocks))
    stream = trips.stream_trips(spark, f"{tmp_path}/topic", max_files=1)
    query = drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    dropped = {p["batchId"]: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in query.recentProgress}
    judged = watermarks.judged(batches(spark, *groups)).where("late")
    # The stream counts what reaches the operator: one row for each window and batch.
    ours = dict(judged.groupBy("batch").agg(F.count_distinct("window_start")).collect())
    assert ours == {batch: n for batch, n in dropped.items() if n} and ours
    kept = watermarks.late_data(batches(spark, *groups)).where("accepted > 0")
    assert {r["window_start"]: r["accepted"] for r in kept.collect()} == {
        r["window_start"]: r["trip_count"] for r in trips.read_hourly(spark, f"{tmp_path}/out").collect()
    }


def test_watermarks_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(watermarks, "_BATCHES_PER_CHUNK", 3)
    rng = random.Random(3)
    day = datetime(2024, 1, 5)
    rows = [(rng.randrange(0, 40, 2) - 10, day + timedelta(seconds=rng.randrange(400_000))) for _ in range(300)]
    rows += [(4, None), (None, day)]
    df = spark.createDataFrame(rows, "batch int, t timestamp_ntz")
    got = {r["batch"]: r["watermark"] for r in watermarks.batch_watermarks(df, event_time="t").collect()}
    numbers = sorted({b for b, _ in rows if b is not None})
    for place, number in enumerate(numbers):
        seen = [t for b, t in rows if t and b is not None and b in numbers[: max(place - 1, 0)]]
        assert got[number] == (max(seen) - timedelta(hours=1) if seen else None)
    walked = watermarks.judged(df, event_time="t").collect()
    assert len(walked) == len(rows)
    for r in walked:
        if r["t"] is None or r["batch"] is None:
            assert not r["late"]
            continue
        assert r["window_start"] == r["t"].replace(minute=0, second=0)
        mark = got[r["batch"]]
        assert r["late"] == (mark is not None and r["window_end"] <= mark)


def test_no_events(spark):
    assert watermarks.late_data(batches(spark)).collect() == []


def test_log_tables_of_a_stopped_and_restarted_query(spark, tmp_path):
    topic, checkpoint = f"{tmp_path}/topic", f"{tmp_path}/cp"

    def run():
        stream = trips.stream_trips(spark, topic, max_files=1)
        drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", checkpoint, available_now=True))

    assert query_log.stream_batches(spark, checkpoint).collect() == []
    late_files(topic)
    run()
    first = {r["batch_id"] for r in query_log.stream_batches(spark, checkpoint).where("committed").collect()}
    put(topic, "file 4+ü.json", event("06:00:00"))
    found = {r["file"].rsplit("/", 1)[1]: (r["batches"], r["in_topic"]) for r in query_log.audit_files(spark, checkpoint, topic).collect()}
    assert found == {"1.json": (1, True), "2.json": (1, True), "3.json": (1, True), "file 4+ü.json": (0, True)}
    run()
    rows = query_log.audit_files(spark, checkpoint, topic).collect()
    assert len(rows) == 4 and all((r["batches"], r["committed_batches"], r["in_topic"]) == (1, 1, True) for r in rows)
    after = query_log.stream_batches(spark, checkpoint)
    assert after.where("NOT committed").isEmpty() and {r["batch_id"] for r in after.collect()} > first
    held = {r["window"]["start"].hour: r["count"] for r in query_log.state_rows(spark, checkpoint).collect()}
    assert held.items() <= {0: 1, 5: 4, 6: 1}.items() and held[6] == 1


def test_log_shows_a_batch_that_never_ended(spark, tmp_path):
    topic, checkpoint = f"{tmp_path}/topic", f"{tmp_path}/cp"
    put(topic, "1.json", event("07:00:00"))

    def broken(batch, number):
        raise RuntimeError("sink is down")

    stream = trips.stream_trips(spark, topic)
    query = stream.writeStream.foreachBatch(broken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="sink is down"):
        query.awaitTermination(60)
    assert [(r["batch_id"], r["committed"]) for r in query_log.stream_batches(spark, checkpoint).collect()] == [(0, False)]
    (row,) = query_log.audit_files(spark, checkpoint, topic).collect()
    assert (row["batches"], row["committed_batches"]) == (1, 0)
