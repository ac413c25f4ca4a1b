from __future__ import annotations

import json
import os
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, bronze
from tripstrata import constants as C
from tripstrata.operators import replay, silver
from tripstrata.streaming import ticks, topics, trips


def event(clock: str, total: float = 10.0, **changes) -> str:
    pickup = datetime.fromisoformat(f"2024-01-05T{clock}")
    fields = {
        **BASE,
        C.PICKUP: pickup.isoformat(),
        C.DROPOFF: (pickup + timedelta(minutes=9)).isoformat(),
        "total_amount": total,
        C.PICKUP_YEAR_FLAG: False,
        C.DROPOFF_YEAR_FLAG: False,
        **changes,
    }
    fields.pop("period")
    return json.dumps(fields)


def put(folder: str, name: str, *lines: str) -> None:
    os.makedirs(folder, exist_ok=True)
    path = Path(folder, name)
    path.write_text("\n".join(lines) + "\n")
    put.clock = getattr(put, "clock", time.time() - 1000) + 1
    os.utime(path, (put.clock, put.clock))  # files are taken in order of their times


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def hours(spark, path):
    return {row.window_start.hour: (row.trip_count, row.revenue) for row in trips.read_hourly(spark, path).collect()}


def late_files(folder):
    put(folder, "1.json", event("00:10:00"), event("05:10:00"))
    put(folder, "2.json", event("05:15:00"), event("05:20:00"))
    put(folder, "3.json", event("00:20:00"), event("05:30:00"))


def test_update_mode_drops_late_events_and_keeps_hours_current(spark, tmp_path):
    late_files(f"{tmp_path}/topic")
    stream = trips.stream_trips(spark, f"{tmp_path}/topic", max_files=1)
    query = drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert hours(spark, f"{tmp_path}/out") == {0: (1, 10.0), 5: (4, 40.0)}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    def run():
        stream = trips.stream_trips(spark, f"{tmp_path}/topic")
        drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))

    put(f"{tmp_path}/topic", "1.json", event("07:00:00"), event("07:30:00"))
    run()
    put(f"{tmp_path}/topic", "2.json", event("07:40:00", 5.0), event("08:00:00"))
    run()
    run()
    assert hours(spark, f"{tmp_path}/out") == {7: (3, 25.0), 8: (1, 10.0)}


def test_append_mode_writes_closed_hours_once(spark, tmp_path):
    late_files(f"{tmp_path}/topic")
    stream = trips.stream_trips(spark, f"{tmp_path}/topic", max_files=1)
    drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", "append", True))
    closed = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(row.window_start.hour, row.trip_count) for row in closed] == [(0, 1)]


def test_sorted_updates_are_refused(spark, tmp_path):
    put(f"{tmp_path}/topic", "1.json", event("07:00:00"))
    ordered = trips.stream_hourly(trips.stream_trips(spark, f"{tmp_path}/topic")).orderBy("window_start")
    with pytest.raises(Exception, match="[Ss]ort"):
        ordered.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/cp").start()


def test_malformed_events_are_skipped(spark, tmp_path):
    good = event("07:00:00")
    put(
        f"{tmp_path}/topic", "1.json", good, "garbage", "", '{"VendorID": "x"}', good[:-20],
        event("08:00:00", total_amount="much"), event("09:00:00", passenger_count=None), event("10:00:00", unknown=1),
    )
    stream = trips.stream_trips(spark, f"{tmp_path}/topic")
    drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    assert sorted(hours(spark, f"{tmp_path}/out")) == [7, 9, 10]


def test_latest_skips_the_backlog(spark, tmp_path):
    put(f"{tmp_path}/topic", "1.json", event("07:00:00"))
    since = datetime.now(timezone.utc) - timedelta(seconds=5)
    new = Path(f"{tmp_path}/topic/2.json")
    new.write_text(event("08:00:00") + "\n")
    stream = trips.stream_trips(spark, f"{tmp_path}/topic", starting_offsets="latest", since=since)
    drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    assert sorted(hours(spark, f"{tmp_path}/out")) == [8]
    with pytest.raises(ValueError):
        trips.stream_trips(spark, f"{tmp_path}/topic", starting_offsets="now")


def test_latest_keeps_its_start_over_a_restart(spark, tmp_path):
    put(f"{tmp_path}/topic", "1.json", event("07:00:00"))
    old = time.time() - 60
    os.utime(f"{tmp_path}/topic/1.json", (old, old))

    def run():
        stream = trips.stream_trips(
            spark, f"{tmp_path}/topic", starting_offsets="latest", checkpoint=f"{tmp_path}/cp"
        )
        drain(trips.start_hourly(trips.stream_hourly(stream), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))

    time.sleep(1.1)
    put(f"{tmp_path}/topic", "0.json", event("06:00:00"))
    os.utime(f"{tmp_path}/topic/0.json", (old, old))
    run()
    assert not Path(f"{tmp_path}/out").exists() or hours(spark, f"{tmp_path}/out") == {}
    Path(f"{tmp_path}/topic/2.json").write_text(event("08:00:00") + "\n")  # arrives while the query is stopped
    time.sleep(1.1)
    run()
    assert sorted(hours(spark, f"{tmp_path}/out")) == [8]


def test_timeout_stops_a_running_query(spark, tmp_path):
    put(f"{tmp_path}/topic", "1.json", event("07:00:00"))
    stream = trips.stream_trips(spark, f"{tmp_path}/topic")
    query = trips.start_hourly(trips.stream_hourly(stream), None, f"{tmp_path}/cp")
    trips.run_stream(query, timeout_s=4)
    assert not query.isActive


def test_published_events_survive_the_round_trip(spark, tmp_path):
    odd = {"passenger_count": None, "store_and_fwd_flag": None, C.PICKUP: datetime(2024, 1, 5, 10, 0, 0, 123456)}
    chosen = silver.silver_accepted(bronze(spark, {}, odd)).drop("period")
    replay.replay_publish(chosen, f"{tmp_path}/topic")
    lines = [json.loads(line) for path in Path(f"{tmp_path}/topic").glob("*.txt") for line in path.read_text().splitlines()]
    assert all(set(line) == set(chosen.columns) for line in lines)
    back = trips.decode_trips(spark.read.text(f"{tmp_path}/topic"))
    assert back.schema == chosen.schema or back.dtypes == chosen.dtypes
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, chosen.collect()), key=str)


def _arrivals(spark, rows):
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(seconds=s), fare, fare, distance) for s, fare, distance in rows]
    return spark.createDataFrame(data, "arrived_at timestamp_ntz, total_amount double, fare_amount double, trip_distance double")


ARRIVALS = [(1.0, 10.0, 1.0), (1.9, 20.0, None), (2.0, 5.5, 2.0), (9.5, None, 4.0), (4001.0, 1.0, 1.0)]


def brute_ticks(rows):
    by_tick = {}
    for second, fare, distance in rows:
        by_tick.setdefault(int(second // 2), []).append((fare or 0.0, distance or 0.0))
    expected = []
    for tick in range(min(by_tick), max(by_tick) + 1):
        hit = by_tick.get(tick, [])
        n = len(hit)
        fares, distances = sum(f for f, _ in hit), sum(d for _, d in hit)
        ended = datetime(2024, 1, 1) + timedelta(seconds=2 * tick + 2)
        expected.append((ended, n, n / 2, fares, fares / n if n else 0.0, distances / n if n else 0.0))
    return expected


def test_ticks_against_brute_force(spark):
    found = ticks.live_ticks(_arrivals(spark, ARRIVALS)).orderBy("window_ended_at").collect()
    assert [tuple(row) for row in found] == brute_ticks(ARRIVALS)
    assert ticks.live_ticks(_arrivals(spark, [])).count() == 0


def test_streamed_ticks_merge_across_batches(spark, tmp_path):
    source = f"{tmp_path}/arrivals"
    frame = _arrivals(spark, ARRIVALS)
    for part in (ARRIVALS[:1], ARRIVALS[1:3], ARRIVALS[3:]):
        _arrivals(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    drain(ticks.start_ticks(stream, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    assert len(list(Path(f"{tmp_path}/out").glob("batch=*"))) == 3
    found = ticks.read_ticks(spark, f"{tmp_path}/out").orderBy("window_ended_at").collect()
    assert [tuple(row) for row in found] == brute_ticks(ARRIVALS)


def test_ticks_by_arrival_time(spark, tmp_path):
    put(f"{tmp_path}/topic", "1.json", event("07:00:00"), event("07:10:00"))
    stream = trips.stream_trips(spark, f"{tmp_path}/topic")
    drain(ticks.start_ticks(stream, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    assert ticks.read_ticks(spark, f"{tmp_path}/out").agg(F.sum("trip_count")).first()[0] == 2


def test_topic_stats(spark):
    rows = [("trips", 0, 5, 25), ("trips", 1, 0, 10), ("trips", 2, None, 9), ("alerts", 0, 7, 3), ("__offsets", 0, 0, 99), ("", 0, 0, 9)]
    df = spark.createDataFrame(rows, "topic string, partition int, first_offset bigint, last_offset bigint")
    assert [tuple(r) for r in topics.topic_stats(df).collect()] == [("alerts", 1, 0), ("trips", 3, 30)]
