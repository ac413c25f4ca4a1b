"""Run log, dashboards, replay and lookups on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, bronze
from tripstrata import constants as C
from tripstrata import schemas
from tripstrata.operators import dashboards, features, replay, runlog, silver


def run(n, job_type="train", status="succeeded", started=None, finished=None, **more):
    row = {
        "id": str(n), "job_type": job_type, "status": status, "params": "{}", "submitted_at": datetime(2024, 1, 1, 0, n),
        "started_at": started, "finished_at": finished, "exit_code": None, "error": None, "log_output": None,
        "rows_processed": None, "metrics": None, **more,
    }
    return tuple(row[name] for name in schemas.RUN_LOG.names)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RUN_LOG)


def test_durations(spark):
    start = datetime(2024, 1, 1, 0, 0, 0)
    rows = [
        run(0, started=start, finished=datetime(2024, 1, 1, 0, 0, 2, 500000)),
        run(1, status="running", started=start),
        run(2, status="queued"),
        run(3, started=start, finished=datetime(2023, 12, 31)),
        run(4, started=start, finished=datetime(2024, 1, 1, 0, 0, 2, 499999)),
    ]
    found = runlog.with_duration(log(spark, *rows), "2024-01-01 00:01:00").orderBy("id").collect()
    assert [row.duration_seconds for row in found] == [3, 60, None, 0, 2]


def test_health_needs_both_times_only_for_the_mean(spark):
    start = datetime(2024, 1, 1)
    rows = [
        run(0, "gold", "failed"),
        run(1, "gold", "partial", start, datetime(2024, 1, 1, 0, 0, 10)),
        run(2, "gold", "cancelled", start, datetime(2024, 1, 1, 1)),
        run(3, "silver", "failed", start),
        run(4, "ingest", "running", start),
    ]
    health = [tuple(row) for row in runlog.etl_health(log(spark, *rows)).collect()]
    assert health == [("gold", 0, 1, 1, 10.0), ("silver", 0, 0, 1, None)]
    none = spark.createDataFrame([("x", 0, 0, 0)], "job_type string, succeeded bigint, partial bigint, failed bigint")
    assert tuple(runlog.etl_health_share(none).first()) == ("x", 0.0, 0.0, 0.0)


def test_answers_of_an_empty_log(spark):
    empty = log(spark)
    assert runlog.latest_silver_rows(empty).first()[0] is None
    assert runlog.latest_fare_mae(empty).first()[0] is None
    assert runlog.months_ingested(empty).first()[0] == 0
    assert runlog.list_runs(empty).count() == 0
    assert runlog.etl_health(empty).count() == 0


def test_months_skip_malformed_params(spark):
    def ingest(n, params, status="succeeded"):
        return run(n, "ingest", status, params=params)

    rows = [
        ingest(0, '{"start":"2024-01","end":"2024-03"}'),
        ingest(1, '{"start":"2024-03","end":"2024-04"}', "partial"),
        ingest(2, '{"start":"2024-06","end":"2024-07"}', "failed"),
        ingest(3, '{"start":"2024-09","end":"2024-08"}'),
        ingest(4, '{"start":"2024-9","end":"2024-10"}'),
        ingest(5, '{"start":202401,"end":"2024-12"}'),
        ingest(6, "not json"),
        ingest(7, "{}"),
    ]
    assert runlog.months_ingested(log(spark, *rows)).first()[0] == 4


def test_pages(spark):
    runs = log(spark, *[run(n) for n in range(5)])
    page = runlog.list_runs(runs, 2, 1).collect()
    assert sorted(row.id for row in page) == ["2", "3"] and all(row.has_more for row in page)
    last = runlog.list_runs(runs, 2, 3).collect()
    assert sorted(row.id for row in last) == ["0", "1"] and not any(row.has_more for row in last)
    assert [row.id for row in runlog.get_run(runs, "3").collect()] == ["3"]


def test_latest_run_looks_at_the_newest_ten_only(spark):
    rows = [run(0, "ingest")] + [run(n, "silver" if n % 2 else "gold") for n in range(1, 11)]
    found = {row.job_type: row.id for row in runlog.latest_run_per_type(log(spark, *rows)).collect()}
    assert found == {"silver": "9", "gold": "10"}


def test_signals(spark):
    states = ["succeeded", "partial", "failed", "running", "queued", "cancelled"]
    rows = runlog.with_signal(log(spark, *[run(n, status=s) for n, s in enumerate(states)])).orderBy("id").collect()
    assert [row.signal for row in rows] == ["good", "warn", "crit", "warn", "warn", "warn"]
    assert [row.lineage_signal for row in rows] == ["good", "warn", "crit", "warn", "warn", "crit"]
    kept = runlog.clear_terminal_runs(log(spark, *[run(n, status=s) for n, s in enumerate(states)]))
    assert sorted(row.status for row in kept.collect()) == ["queued", "running"]


def _days(spark, *revenues):
    rows = [(date(2024, 1, 1 + n), 1, revenue, 0.0, 0.0, 0.0) for n, revenue in enumerate(revenues)]
    return spark.createDataFrame(rows, schemas.DAILY_REVENUE)


def test_revenue_change(spark):
    def change(*revenues):
        row = dashboards.revenue_change(_days(spark, *revenues)).first()
        return row and row.change_pct

    assert change(*[999.0] * 3, *[10.0] * 7, *[15.0] * 7) == 50.0
    assert change(10.0, 20.0, 30.0) == 400.0
    assert change(None, 20.0) == 0.0
    assert change(20.0, None) == -100.0
    assert change(5.0) is None
    assert change() is None


def test_dashboard_bundles(spark):
    empty = {name: spark.createDataFrame([], schemas.GOLD[name]) for name in C.GOLD_TABLES}
    overview = dashboards.dashboard_overview(empty, log(spark))
    assert list(overview) == ["daily_revenue", "hourly_demand", "top_zones", "congestion", "model_metrics", "etl_health"]
    assert all(df.count() == 0 for df in overview.values())
    home = dashboards.home_stats(_days(spark, *[1.0] * 20), log(spark))
    assert list(home) == ["silver_rows_processed", "months_ingested", "fare_model_mae", "revenue_trend"]
    assert [row.pickup_date.day for row in home["revenue_trend"].collect()] == list(range(7, 21))
    totals = dashboards.dashboard_totals(empty["daily_revenue"], empty["hourly_demand"], empty["congestion_metrics"])
    assert tuple(totals.first()) == (0.0, 0, 0, 0.0)


def _trips(spark, *pickups):
    changes = [{C.PICKUP: p, C.DROPOFF: datetime(2024, 3, 1)} for p in pickups]
    return silver.silver_accepted(bronze(spark, *changes))


def test_replay_selection(spark):
    rows = [datetime(2024, 1, 5, 10, n) for n in (30, 10, 20)] + [datetime(2024, 1, 6, 9), datetime(2024, 1, 6, 8)]
    trips = _trips(spark, *rows)
    assert [row[C.PICKUP].hour for row in replay.replay_select(trips).collect()] == [8, 9]
    chosen = replay.replay_select(trips, "2024-01-05", 2).collect()
    assert [row[C.PICKUP].minute for row in chosen] == [10, 20]
    assert replay.replay_select(trips, "2020-01-01").count() == 0
    assert replay.replay_select(trips, "2024-01-05", -3).count() == 1
    with pytest.raises(ValueError):
        replay.replay_select(trips.where("false"))


def test_replay_limits(spark):
    many = _trips(spark, datetime(2024, 1, 5, 10)).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(6000)))).drop("_n")
    assert replay.replay_select(many, "2024-01-05", 99_999).count() == 6000
    whole = replay.replay_schedule(replay.replay_select(many, "2024-01-05", None), rate=100)
    assert [row.event_number for row in whole.orderBy("event_number").collect()] == list(range(6000))
    for asked in (99_999, None):
        with pytest.warns(UserWarning, match="5000"):
            assert replay.replay_select(many, "2024-01-05", asked, max_limit=5000).count() == 5000
    assert replay.replay_select(many, "2024-01-05").count() == 500


def test_replay_schedules(spark):
    trips = _trips(spark, *[datetime(2024, 1, 5, 10, 0, s) for s in (0, 0, 30)], datetime(2024, 1, 5, 13))
    flat = replay.replay_schedule(trips, rate=1000, speed=2).orderBy("event_number").collect()
    assert [row.send_at_s for row in flat] == [0.0, 0.005, 0.01, 0.015]
    slow = replay.replay_schedule(trips, rate=0.001).orderBy("event_number").collect()
    assert [row.send_at_s for row in slow] == [0.0, 10.0, 20.0, 30.0]
    with pytest.raises(ValueError):
        replay.replay_schedule(trips, speed=4)
    gaps = replay.replay_schedule_gap(trips, 60).orderBy("send_at_s").collect()
    assert [row.send_at_s for row in gaps] == [0.0, 0.0, 0.5, 180.0]
    assert {row.send_at_s for row in replay.replay_schedule_gap(trips).collect()} == {0.0}
    waits = [(row.events, row.wait_s) for row in replay.replay_gaps(trips, 60).orderBy(C.PICKUP).collect()]
    assert waits == [(2, 0.0), (1, 0.5), (1, 179.5)]


def test_lookup_reports_missing_features(spark):
    trips = silver.silver_accepted(bronze(spark, {}))
    requests = spark.createDataFrame([(10, 10), (10, 11), (99, 10)], "PULocationID int, pickup_hour int")
    found = features.feature_lookup(requests, features.zone_hour_features(trips)).orderBy(C.PICKUP_ZONE, "pickup_hour")
    assert [(row.found, row.trip_count) for row in found.collect()] == [(True, 1), (False, None), (False, None)]


def test_online_value_keeps_null_and_rounds(spark):
    rows = bronze(spark, {"passenger_count": None, "fare_amount": 1.0}, {"passenger_count": None, "fare_amount": 1.0}, {"passenger_count": None, "fare_amount": 2.0})
    snapshot = features.publish_online(features.zone_hour_features(silver.silver_accepted(rows))).first()
    assert snapshot.key == "features:zone:10:hour:10"
    assert '"avg_fare":1.3333' in snapshot.value and '"avg_passenger_count":null' in snapshot.value
    assert BASE[C.PICKUP].hour == 10
