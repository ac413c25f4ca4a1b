from __future__ import annotations

from datetime import datetime

from tripstrata import schemas

BASE = {
    "VendorID": 1,
    "tpep_pickup_datetime": datetime(2024, 1, 5, 10, 0),
    "tpep_dropoff_datetime": datetime(2024, 1, 5, 10, 20),
    "passenger_count": 1.0,
    "trip_distance": 2.5,
    "RatecodeID": 1.0,
    "store_and_fwd_flag": "N",
    "PULocationID": 10,
    "DOLocationID": 20,
    "payment_type": 1,
    "fare_amount": 12.0,
    "extra": 0.0,
    "mta_tax": 0.5,
    "tip_amount": 2.0,
    "tolls_amount": 0.0,
    "improvement_surcharge": 1.0,
    "total_amount": 15.5,
    "congestion_surcharge": 2.5,
    "Airport_fee": 0.0,
    "period": "2024-01",
}


def bronze(spark, *changes: dict):
    """Good trips, each with the given changes."""
    rows = [tuple({**BASE, **change}[f.name] for f in schemas.BRONZE_TABLE.fields) for change in changes]
    return spark.createDataFrame(rows, schemas.BRONZE_TABLE)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
