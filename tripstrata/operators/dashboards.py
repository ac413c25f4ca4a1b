"""Key figures and trends over the Gold tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.fixed_point import exact_sum
from . import runlog
from .gold import gold_order


def _stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_zones(zone_stats: DataFrame, k: int = C.TOP_ZONES) -> DataFrame:
    return zone_stats.orderBy(*gold_order("zone_stats")).limit(k)


def revenue_last(daily: DataFrame, n: int = C.TREND_DAYS) -> DataFrame:
    """The last ``n`` days present, oldest first."""
    return daily.orderBy(F.desc("pickup_date")).limit(n).orderBy("pickup_date")


def revenue_change(daily: DataFrame, n: int = C.TREND_DAYS) -> DataFrame:
    """Change of the window's second half against its first, in percent; no row under two days."""
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    # At most n rows pass the limit, so the ordered window is small whatever the table holds.
    position = F.row_number().over(Window.orderBy("pickup_date"))
    days = daily.orderBy(F.desc("pickup_date")).limit(n).select(revenue.alias("revenue"), position.alias("position"))
    middle = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)
    halves = days.withColumn("second", F.col("position") > middle)
    sums = halves.agg(
        F.count(F.lit(1)).alias("days"),
        exact_sum("revenue").alias("total_revenue"),
        exact_sum(F.when(~F.col("second"), F.col("revenue"))).alias("first_half"),
        exact_sum(F.when(F.col("second"), F.col("revenue"))).alias("second_half"),
    ).where(F.col("days") >= 2)
    change = (F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100
    return sums.withColumn("change_pct", F.when(F.col("first_half") != 0, change).otherwise(0.0))


def latest_kpis(daily: DataFrame, hourly: DataFrame, congestion: DataFrame) -> DataFrame:
    """Average fare and congestion share of the latest day, average fare of the first hour."""
    rows = _stack(
        daily.select(F.col("pickup_date").alias("fare_day"), "avg_fare"),
        congestion.select(F.col("pickup_date").alias("congestion_day"), "congestion_trip_pct"),
        hourly.select("pickup_hour", F.col("avg_fare").alias("hour_fare")),
    )
    return rows.agg(
        F.max_by("avg_fare", "fare_day").alias("latest_avg_fare"),
        F.max_by("congestion_trip_pct", "congestion_day").alias("latest_congestion_pct"),
        F.min_by("hour_fare", "pickup_hour").alias("first_hour_avg_fare"),
    )


def dashboard_totals(daily: DataFrame, hourly: DataFrame, congestion: DataFrame) -> DataFrame:
    """Headline sums of the dashboard; missing values count as zero."""
    rows = _stack(
        daily.select("total_revenue", F.col("trip_count").alias("daily_trips")),
        hourly.select(F.col("trip_count").alias("hourly_trips")),
        congestion.select("total_congestion_surcharge"),
    )
    return rows.agg(
        F.coalesce(exact_sum("total_revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("daily_trips"), F.lit(0)).alias("daily_trips"),
        F.coalesce(F.sum("hourly_trips"), F.lit(0)).alias("hourly_trips"),
        F.coalesce(exact_sum("total_congestion_surcharge"), F.lit(0.0)).alias("total_congestion_surcharge"),
    )


def dashboard_overview(gold: dict[str, DataFrame], run_log: DataFrame) -> dict[str, DataFrame]:
    """The six datasets of the dashboard."""
    return {
        "daily_revenue": gold["daily_revenue"].orderBy(*gold_order("daily_revenue")),
        "hourly_demand": gold["hourly_demand"].orderBy(*gold_order("hourly_demand")),
        "top_zones": top_zones(gold["zone_stats"]),
        "congestion": gold["congestion_metrics"].orderBy(*gold_order("congestion_metrics")),
        "model_metrics": runlog.train_metrics(run_log),
        "etl_health": runlog.etl_health(run_log),
    }


def home_stats(daily: DataFrame, run_log: DataFrame) -> dict[str, DataFrame]:
    """The four figures of the home page."""
    return {
        "silver_rows_processed": runlog.latest_silver_rows(run_log),
        "months_ingested": runlog.months_ingested(run_log),
        "fare_model_mae": runlog.latest_fare_mae(run_log),
        "revenue_trend": revenue_last(daily),
    }
