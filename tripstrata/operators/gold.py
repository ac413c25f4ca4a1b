"""Gold aggregates over Silver trips.

Each table accepts Silver trips or a ``trip_rollup`` of them. The rollup holds additive totals per
pickup date, hour, zone and flag, at most a few million rows whatever the number of trips, so one
scan and one shuffle of Silver serve every Gold table and the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.fixed_point import mean, merge, parts, total
from .silver import exclude_year_mismatch, has_congestion

_KEYS = {
    "pickup_date": lambda: F.to_date(C.PICKUP),
    "pickup_hour": lambda: F.hour(C.PICKUP),
    C.PICKUP_ZONE: lambda: F.col(C.PICKUP_ZONE),
    C.DROPOFF_ZONE: lambda: F.col(C.DROPOFF_ZONE),
    C.PICKUP_YEAR_FLAG: lambda: F.col(C.PICKUP_YEAR_FLAG),
    "period": lambda: F.col("period"),
}
ROLLUP_KEYS = ("pickup_date", "pickup_hour", C.PICKUP_ZONE, C.PICKUP_YEAR_FLAG)

_MEASURES = {
    "total": "total_amount",
    "fare": "fare_amount",
    "tip": "tip_amount",
    "distance": "trip_distance",
    "passengers": "passenger_count",
    "surcharge": "congestion_surcharge",
}
_COUNTS = ("trip_count", "trips_with_congestion")


def trip_rollup(source: DataFrame, *keys: str) -> DataFrame:
    """Additive totals per ``keys``. Totals that the caller does not read are pruned by Catalyst."""
    keys = keys or ROLLUP_KEYS
    if "trip_count" in source.columns:
        totals = [F.sum(name).alias(name) for name in _COUNTS]
        totals += [column for name in _MEASURES for column in merge(name)]
        return source.groupBy(*keys).agg(*totals)
    totals = [
        F.count(F.lit(1)).alias("trip_count"),
        F.count_if(has_congestion()).alias("trips_with_congestion"),
    ]
    totals += [column for name, value in _MEASURES.items() for column in parts(value, name)]
    return source.groupBy(*[_KEYS[key]().alias(key) for key in keys]).agg(*totals)


def _columns(**named: Column) -> list[Column]:
    return [value.alias(name) for name, value in named.items()]


def daily_revenue(source: DataFrame) -> DataFrame:
    days = trip_rollup(exclude_year_mismatch(source), "pickup_date")
    return days.select(
        "pickup_date",
        "trip_count",
        *_columns(
            total_revenue=total("total"), total_fare=total("fare"), total_tips=total("tip"), avg_fare=mean("fare")
        ),
    ).orderBy("pickup_date")


def hourly_demand(source: DataFrame) -> DataFrame:
    hours = trip_rollup(source, "pickup_hour")
    return hours.select(
        "pickup_hour",
        "trip_count",
        *_columns(
            avg_fare=mean("fare"), avg_trip_distance=mean("distance"), avg_passenger_count=mean("passengers")
        ),
    ).orderBy("pickup_hour")


def zone_stats(source: DataFrame, column: str = C.PICKUP_ZONE) -> DataFrame:
    zones = trip_rollup(source, column)
    return zones.select(
        column,
        "trip_count",
        *_columns(
            total_revenue=total("total"),
            avg_fare=mean("fare"),
            avg_trip_distance=mean("distance"),
            avg_tip=mean("tip"),
        ),
    ).orderBy(F.desc("trip_count"), column)


def congestion_metrics(source: DataFrame) -> DataFrame:
    days = trip_rollup(exclude_year_mismatch(source), "pickup_date")
    return days.select(
        "pickup_date",
        "trip_count",
        "trips_with_congestion",
        *_columns(
            total_congestion_surcharge=total("surcharge"),
            congestion_trip_pct=F.col("trips_with_congestion") / F.col("trip_count") * 100,
        ),
    ).orderBy("pickup_date")


BUILDERS = {
    "daily_revenue": daily_revenue,
    "hourly_demand": hourly_demand,
    "zone_stats": zone_stats,
    "congestion_metrics": congestion_metrics,
}

_ORDER = {
    "daily_revenue": lambda: [F.col("pickup_date")],
    "hourly_demand": lambda: [F.col("pickup_hour")],
    "zone_stats": lambda: [F.desc("trip_count"), F.col(C.PICKUP_ZONE)],
    "congestion_metrics": lambda: [F.col("pickup_date")],
    C.FEATURE_TABLE: lambda: [F.col(C.PICKUP_ZONE), F.col("pickup_hour")],
}


def gold_order(name: str) -> list[Column]:
    """Sort order of a Gold table. Files hold none, so readers apply it."""
    return _ORDER[name]()


def max_pickup_date(silver: DataFrame) -> DataFrame:
    """Latest pickup date, NULL when there are no trips."""
    return silver.agg(F.max(C.PICKUP).alias("_latest")).select(F.to_date("_latest").alias("max_pickup_date"))
