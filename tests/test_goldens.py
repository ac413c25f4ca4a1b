"""Published counts for the adapters at sf0.01, and the invariants of quality reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripstrata import constants as C
from tripstrata.operators import features, gold, profile, runlog, service, silver
from tripstrata.sources import adapters
from tripstrata.streaming import ticks


@pytest.fixture(scope="module")
def bronze(spark, medium):
    return adapters.bronze(spark, medium)


@pytest.fixture(scope="module")
def report(bronze):
    return [row.asDict() for row in silver.quality_report(bronze).collect()]


def _total(report, column):
    return sum(row[column] for row in report)


def test_quality_totals(report):
    assert len(report) == 80
    assert _total(report, "records_processed") == 60_141
    assert _total(report, "records_accepted") == 47_435
    assert _total(report, "records_rejected") == 2_149
    assert _total(report, "records_quarantined") == 10_557
    assert _total(report, "duplicate_records") == 141
    assert _total(report, "invalid_timestamps") == 1_565
    assert _total(report, "distance_outliers") == 1_187
    assert _total(report, "invalid_passenger_counts") == 8_267
    assert _total(report, "negative_fares") == 1_246
    assert _total(report, "negative_total_amounts") == 441
    assert _total(report, "records_flagged_pickup_year_mismatch") == 235
    assert _total(report, "records_flagged_dropoff_year_mismatch") == 235
    assert sum(row["missing_value_counts"]["passenger_count"] for row in report) == 8_619


def test_quality_invariants(report):
    for row in report:
        kept = row["records_accepted"] + row["records_rejected"] + row["records_quarantined"]
        assert kept == row["records_processed"]
        categories = (
            row["invalid_timestamps"]
            + row["negative_fares"]
            + row["invalid_passenger_counts"]
            + row["distance_outliers"]
            + row["negative_total_amounts"]
        )
        assert categories == row["records_rejected"] + row["records_quarantined"]
        assert len(set(row["missing_value_counts"].asDict().values())) == 1


def test_gold_goldens(spark, medium):
    trips = adapters.silver(spark, medium)
    days = gold.daily_revenue(trips).agg(
        F.count("*"), F.sum("trip_count"), F.sum(F.col("total_revenue").cast("decimal(18,8)")).cast("string")
    )
    assert tuple(days.first()) == (2_398, 47_200, "2608814.37549070")
    assert gold.congestion_metrics(trips).agg(F.sum("trips_with_congestion")).first()[0] == 13_158
    cells = features.zone_hour_features(trips)
    assert tuple(cells.agg(F.count("*"), F.sum("trip_count")).first()) == (2_400, 47_435)
    assert (gold.zone_stats(trips).count(), gold.hourly_demand(trips).count()) == (100, 24)


def test_quantile_goldens(bronze):
    assert tuple(profile.profile_quantiles(bronze).first()) == (12.0, 101.0, 146.0)


def test_run_log_goldens(spark, medium):
    runs = adapters.run_log(adapters.table(spark, medium, "events"))
    health = {
        row.job_type: (row.succeeded, row.partial, row.failed, round(row.avg_duration_seconds, 6))
        for row in runlog.etl_health(runs).collect()
    }
    assert health == {
        "features": (987, 210, 203, 50.031636),
        "gold": (1006, 204, 211, 49.95183),
        "ingest": (997, 191, 219, 51.136283),
        "silver": (1002, 201, 184, 49.444694),
        "train": (1008, 194, 183, 47.342209),
    }
    assert runlog.months_ingested(runs).first()[0] == 9
    assert runlog.latest_fare_mae(runs).first()[0] == 7.0
    assert runlog.latest_silver_rows(runs).first()[0] == 78_000
    counts = dict(runs.groupBy("status").count().collect())
    assert counts == {"succeeded": 5_000, **dict.fromkeys(("failed", "partial", "queued", "running", "cancelled"), 1_000)}


def test_service_goldens(spark, medium):
    log = adapters.request_log(adapters.table(spark, medium, "events"))
    windows = service.svc_requests_5m(log).agg(F.count("*"), F.sum("requests")).first()
    assert tuple(windows) == (5_944, 10_000)
    assert service.svc_error_rate(log).agg(F.sum("error_rate_pct")).first()[0] == pytest.approx(118118.809524)
    p95 = service.svc_latency_percentiles(log).agg(F.sum("p95")).first()[0]
    assert p95 == pytest.approx(372.395105)


def test_tick_goldens(spark, medium):
    events = adapters.arrivals(adapters.table(spark, medium, "events"))
    hour = ticks.live_ticks(events).where(F.col("window_ended_at") <= F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"))
    # The first event arrives after midnight, so the ticks before it do not exist here.
    empty, trips, revenue = hour.agg(
        F.count_if(F.col("trip_count") == 0), F.sum("trip_count"), F.sum("total_revenue")
    ).first()
    assert trips == 21
    assert revenue == pytest.approx(1008.66)
    assert hour.count() - empty == 21


def test_rollup_gives_the_same_gold(spark, medium):
    trips = adapters.silver(spark, medium)
    cells = gold.trip_rollup(trips)
    for name, build in {**gold.BUILDERS, C.FEATURE_TABLE: features.zone_hour_features}.items():
        order = gold.gold_order(name)
        assert build(cells).orderBy(*order).collect() == build(trips).orderBy(*order).collect(), name
