"""Request-log metrics: rates, error share and exact latency percentiles per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles

_PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _windowed(request_log: DataFrame, minutes: int) -> DataFrame:
    start = F.window("requested_at", f"{minutes} minutes").start
    return request_log.withColumn("window_start", start)


def svc_requests_5m(request_log: DataFrame) -> DataFrame:
    return _windowed(request_log, 5).groupBy("window_start").agg(F.count(F.lit(1)).alias("requests"))


def svc_error_rate(request_log: DataFrame) -> DataFrame:
    share = F.count_if(F.col("status") == "5xx") * 100.0 / F.count(F.lit(1))
    return _windowed(request_log, 5).groupBy("window_start").agg(share.cast("double").alias("error_rate_pct"))


def svc_rate_by_handler(request_log: DataFrame) -> DataFrame:
    rate = F.count(F.lit(1)) / 60.0
    return _windowed(request_log, 1).groupBy("window_start", "handler").agg(rate.alias("requests_per_second"))


def svc_rate_by_status(request_log: DataFrame) -> DataFrame:
    rate = F.count(F.lit(1)) / 300.0
    return _windowed(request_log, 5).groupBy("window_start", "status").agg(rate.alias("requests_per_second"))


def svc_latency_percentiles(request_log: DataFrame) -> DataFrame:
    return exact_percentiles(_windowed(request_log, 5), "duration_s", _PERCENTILES, ["window_start"])


def svc_p95_by_handler(request_log: DataFrame) -> DataFrame:
    wanted = {"p95": _PERCENTILES["p95"]}
    return exact_percentiles(_windowed(request_log, 5), "duration_s", wanted, ["window_start", "handler"])
