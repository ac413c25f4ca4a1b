from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, bronze
from tripstrata import constants as C
from tripstrata import schemas
from tripstrata.operators import gold, silver

NAN = float("nan")


def outcomes(df):
    routed = silver.with_outcome(silver.nan_to_null(df))
    return [row.outcome for row in routed.orderBy("VendorID").collect()]


def numbered(*changes):
    return [{**change, "VendorID": n} for n, change in enumerate(changes)]


def test_missing_values_pass_every_comparison(spark):
    nullable = ("passenger_count", "trip_distance", "fare_amount", "total_amount")
    rows = [{name: None} for name in nullable] + [{name: NAN} for name in nullable]
    assert outcomes(bronze(spark, *numbered(*rows))) == [C.ACCEPTED] * 8


def test_rules_never_give_null(spark):
    empty = dict.fromkeys(BASE, None)
    row = bronze(spark, {**empty, "period": "2024-01"}).select(*[rule().alias(n) for n, rule in silver.RULES.items()])
    assert row.first().asDict() == {name: name in ("slv_001", "slv_002") for name in silver.RULES}


@pytest.mark.parametrize(
    "change, outcome",
    [
        ({C.PICKUP: None}, C.INVALID_TIMESTAMPS),
        ({C.DROPOFF: None}, C.INVALID_TIMESTAMPS),
        ({C.DROPOFF: BASE[C.PICKUP]}, C.INVALID_TIMESTAMPS),
        ({C.DROPOFF: datetime(2024, 1, 5, 9)}, C.INVALID_TIMESTAMPS),
        ({"trip_distance": -0.1}, C.DISTANCE_OUTLIERS),
        ({"trip_distance": 100.0}, C.ACCEPTED),
        ({"trip_distance": 100.1}, C.DISTANCE_OUTLIERS),
        ({"passenger_count": 0.0}, C.INVALID_PASSENGER_COUNT),
        ({"fare_amount": -0.01}, C.NEGATIVE_FARES),
        ({"fare_amount": 0.0}, C.ACCEPTED),
        ({"total_amount": -1.0}, C.NEGATIVE_TOTAL_AMOUNTS),
        ({"total_amount": -1.0, "fare_amount": -1.0}, C.NEGATIVE_FARES),
        ({"fare_amount": -1.0, "passenger_count": 0.0}, C.INVALID_PASSENGER_COUNT),
        ({"passenger_count": 0.0, "trip_distance": 500.0}, C.DISTANCE_OUTLIERS),
        ({"trip_distance": -5.0, C.PICKUP: None}, C.INVALID_TIMESTAMPS),
    ],
)
def test_one_category_by_priority(spark, change, outcome):
    assert outcomes(bronze(spark, change)) == [outcome]


def test_tiers(spark):
    rows = numbered({C.PICKUP: None}, {"trip_distance": -1.0}, {"trip_distance": 101.0}, {"fare_amount": -1.0}, {})
    tiers = [row.tier for row in silver.with_tier(bronze(spark, *rows)).orderBy("VendorID").collect()]
    assert tiers == ["rejected", "rejected", "quarantined", "quarantined", None]


def test_year_flags_come_from_the_period(spark):
    rollover = {C.PICKUP: datetime(2023, 12, 31, 23, 50), C.DROPOFF: datetime(2024, 1, 1, 0, 10)}
    later = {C.PICKUP: datetime(2025, 1, 1, 1), C.DROPOFF: datetime(2025, 1, 1, 2)}
    old = {C.PICKUP: datetime(2002, 1, 1, 1), C.DROPOFF: datetime(2002, 1, 1, 2)}
    kept = silver.silver_accepted(bronze(spark, *numbered({}, rollover, later, old))).orderBy("VendorID")
    flags = [tuple(row) for row in kept.select(C.PICKUP_YEAR_FLAG, C.DROPOFF_YEAR_FLAG).collect()]
    assert flags == [(False, False), (True, False), (True, False), (True, True)]
    assert kept.columns == schemas.SILVER_TABLE.names
    assert gold.daily_revenue(kept).count() == 1
    assert gold.hourly_demand(kept).agg(F.sum("trip_count")).first()[0] == 4


def test_duplicates(spark):
    other_period = {"period": "2024-02"}
    nulls = {"passenger_count": None, "store_and_fwd_flag": None}
    df = bronze(spark, {}, {}, {}, nulls, nulls, other_period, {"VendorID": 2})
    assert dict(silver.duplicate_count(df).collect()) == {"2024-01": 3}


def test_duplicates_of_a_hot_row(spark):
    hot = bronze(spark, {}).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("_n")
    rest = spark.range(10_000).select(
        *[
            F.col("id").cast("double").alias("fare_amount") if name == "fare_amount" else F.lit(value).alias(name)
            for name, value in BASE.items()
        ]
    )
    rest = rest.select(*[F.col(f.name).cast(f.dataType) for f in schemas.BRONZE_TABLE.fields])
    # One of the ten thousand equals the hot row.
    assert dict(silver.duplicate_count(hot.unionByName(rest)).collect()) == {"2024-01": 5000}


def test_equal_hashes_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(silver.F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    df = bronze(spark, {}, {}, {"VendorID": 2}, {"VendorID": 3})
    assert dict(silver.duplicate_count(df).collect()) == {"2024-01": 1}


def test_report_of_empty_input(spark):
    empty = bronze(spark, {}).where("false")
    assert silver.quality_report(empty).count() == 0
    assert silver.quality_report(empty).schema.names == schemas.QUALITY_REPORT.names
    for build in gold.BUILDERS.values():
        assert build(silver.silver_accepted(empty)).count() == 0
    assert gold.max_pickup_date(silver.silver_accepted(empty)).first()[0] is None


def test_report_from_stored_rows_equals_report_from_bronze(spark, small):
    from tripstrata.sources import adapters

    rows = adapters.bronze(spark, small)
    direct = silver.quality_report(rows).orderBy("period").collect()
    assert silver.quality_report(silver.with_outcome(rows)).orderBy("period").collect() == direct


def test_prototype_differs_where_it_should(spark):
    rows = bronze(spark, *numbered({}, {"passenger_count": None}, {C.DROPOFF: BASE[C.PICKUP]}, {"fare_amount": -1.0, "passenger_count": 0.0}))
    assert [r.VendorID for r in silver.prototype_silver(rows).collect()] == [0]
    quarantined = sorted((r.VendorID, r.rule) for r in silver.prototype_quarantine(rows).collect())
    assert quarantined == [(3, "invalid_passengers"), (3, "negative_fares")]
    assert silver.prototype_report(rows).first().asDict() == {
        "records_processed": 4,
        "records_valid": 1,
        "records_quarantined": 3,
        "negative_fares": 1,
        "invalid_passengers": 1,
        "invalid_timestamps": 0,
        "negative_distances": 0,
    }


def test_zone_order_has_a_tie_break(spark):
    trips = silver.silver_accepted(bronze(spark, {"PULocationID": 9}, {"PULocationID": 3}, {"PULocationID": 5}, {"PULocationID": 5}))
    assert [row.PULocationID for row in gold.zone_stats(trips).collect()] == [5, 3, 9]


def test_congestion_counts_only_positive_surcharges(spark):
    trips = silver.silver_accepted(bronze(spark, {}, {"congestion_surcharge": None}, {"congestion_surcharge": 0.0}, {}))
    row = gold.congestion_metrics(trips).first()
    assert (row.trips_with_congestion, row.total_congestion_surcharge, row.congestion_trip_pct) == (2, 5.0, 50.0)


def test_all_null_measure_is_null(spark):
    trips = silver.silver_accepted(bronze(spark, {"congestion_surcharge": None, "passenger_count": None}))
    assert gold.congestion_metrics(trips).first().total_congestion_surcharge is None
    assert gold.hourly_demand(trips).first().avg_passenger_count is None
