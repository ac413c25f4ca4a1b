"""Declared schemas. Nothing in the library infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as C

_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_TEXT, _BOOL, _DATE = T.StringType(), T.BooleanType(), T.DateType()
_NTZ = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# The column contract of a raw monthly file, in file order.
BRONZE = _struct(
    VendorID=_INT,
    tpep_pickup_datetime=_NTZ,
    tpep_dropoff_datetime=_NTZ,
    passenger_count=_DOUBLE,
    trip_distance=_DOUBLE,
    RatecodeID=_DOUBLE,
    store_and_fwd_flag=_TEXT,
    PULocationID=_INT,
    DOLocationID=_INT,
    payment_type=_LONG,
    fare_amount=_DOUBLE,
    extra=_DOUBLE,
    mta_tax=_DOUBLE,
    tip_amount=_DOUBLE,
    tolls_amount=_DOUBLE,
    improvement_surcharge=_DOUBLE,
    total_amount=_DOUBLE,
    congestion_surcharge=_DOUBLE,
    Airport_fee=_DOUBLE,
)
PERIOD = T.StructField("period", _TEXT, True)
FLAGS = _struct(**{C.PICKUP_YEAR_FLAG: _BOOL, C.DROPOFF_YEAR_FLAG: _BOOL})

SILVER = T.StructType(BRONZE.fields + FLAGS.fields)
BRONZE_TABLE = T.StructType(BRONZE.fields + [PERIOD])
SILVER_TABLE = T.StructType(SILVER.fields + [PERIOD])
ROUTED_TABLE = T.StructType(SILVER.fields + [T.StructField("outcome", _TEXT, True), PERIOD])

DAILY_REVENUE = _struct(
    pickup_date=_DATE,
    trip_count=_LONG,
    total_revenue=_DOUBLE,
    total_fare=_DOUBLE,
    total_tips=_DOUBLE,
    avg_fare=_DOUBLE,
)
HOURLY_DEMAND = _struct(
    pickup_hour=_INT,
    trip_count=_LONG,
    avg_fare=_DOUBLE,
    avg_trip_distance=_DOUBLE,
    avg_passenger_count=_DOUBLE,
)
ZONE_STATS = _struct(
    PULocationID=_INT,
    trip_count=_LONG,
    total_revenue=_DOUBLE,
    avg_fare=_DOUBLE,
    avg_trip_distance=_DOUBLE,
    avg_tip=_DOUBLE,
)
CONGESTION_METRICS = _struct(
    pickup_date=_DATE,
    trip_count=_LONG,
    trips_with_congestion=_LONG,
    total_congestion_surcharge=_DOUBLE,
    congestion_trip_pct=_DOUBLE,
)
FEATURES = _struct(
    PULocationID=_INT,
    pickup_hour=_INT,
    trip_count=_LONG,
    avg_fare=_DOUBLE,
    avg_trip_distance=_DOUBLE,
    avg_tip=_DOUBLE,
    avg_passenger_count=_DOUBLE,
)
GOLD = {
    "daily_revenue": DAILY_REVENUE,
    "hourly_demand": HOURLY_DEMAND,
    "zone_stats": ZONE_STATS,
    "congestion_metrics": CONGESTION_METRICS,
    C.FEATURE_TABLE: FEATURES,
}

QUALITY_REPORT = T.StructType(
    [
        T.StructField("period", _TEXT),
        *[
            T.StructField(name, _LONG)
            for name in (
                "records_processed",
                "records_accepted",
                "records_rejected",
                "records_quarantined",
                "duplicate_records",
                "invalid_timestamps",
                "negative_fares",
                "invalid_passenger_counts",
                "distance_outliers",
                "negative_total_amounts",
                "records_flagged_pickup_year_mismatch",
                "records_flagged_dropoff_year_mismatch",
            )
        ],
        T.StructField("missing_value_counts", _struct(**{c: _LONG for c in C.MONITORED_COLUMNS})),
    ]
)

INGEST_RESULT = _struct(period=_TEXT, status=_TEXT, reason=_TEXT, rows=_LONG, bronze_path=_TEXT)

RUN_LOG = _struct(
    id=_TEXT,
    job_type=_TEXT,
    status=_TEXT,
    params=_TEXT,
    submitted_at=_NTZ,
    started_at=_NTZ,
    finished_at=_NTZ,
    exit_code=_INT,
    error=_TEXT,
    log_output=_TEXT,
    rows_processed=_LONG,
    metrics=_TEXT,
)
RANGE_PARAMS = _struct(start=_TEXT, end=_TEXT)
TRAIN_METRICS = _struct(mae=_DOUBLE, rmse=_DOUBLE, r2=_DOUBLE)

MODEL_RUNS = _struct(
    run_id=_TEXT, started_at=T.TimestampType(), model_path=_TEXT, params=_TEXT, metrics=_TEXT, rows=_LONG
)
