"""Questions about the run log: one row per pipeline run, parameters and metrics as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.times import expand_months, micros_between

def _newest_first() -> list[Column]:
    return [F.desc_nulls_last("submitted_at"), F.desc("id")]


def _succeeded(run_log: DataFrame, job_type: str) -> DataFrame:
    return run_log.where((F.col("job_type") == job_type) & (F.col("status") == "succeeded"))


def _with_metrics(run_log: DataFrame) -> DataFrame:
    trained = _succeeded(run_log, "train").where(F.col("metrics").isNotNull())
    return trained.withColumn("_metrics", F.from_json("metrics", schemas.TRAIN_METRICS))


def etl_health(run_log: DataFrame) -> DataFrame:
    """Finished runs per job type by status, and their mean seconds where both times are known."""
    counted = run_log.where(F.col("status").isin(*C.TERMINAL_COUNTED))
    micros = micros_between("finished_at", "started_at")
    return (
        counted.groupBy("job_type")
        .agg(
            *[F.count_if(F.col("status") == status).alias(status) for status in C.TERMINAL_COUNTED],
            F.sum(micros).alias("_micros"),
            F.count(micros).alias("_timed"),
        )
        .select(
            "job_type",
            *C.TERMINAL_COUNTED,
            F.when(F.col("_timed") > 0, F.col("_micros") / F.col("_timed") / 1e6).alias("avg_duration_seconds"),
        )
        .orderBy("job_type")
    )


def etl_health_share(health: DataFrame) -> DataFrame:
    """Percentage of each status per job type; a type without runs has shares of zero."""
    total = F.greatest(sum((F.col(status) for status in C.TERMINAL_COUNTED), F.lit(0)), F.lit(1))
    return health.select(
        "job_type", *[(F.col(status) / total * 100).alias(f"{status}_pct") for status in C.TERMINAL_COUNTED]
    )


def train_metrics(run_log: DataFrame) -> DataFrame:
    return _with_metrics(run_log).select("finished_at", "_metrics.*").orderBy("finished_at", "mae", "rmse")


def latest_silver_rows(run_log: DataFrame) -> DataFrame:
    """Rows of the latest succeeded Silver run that counted them; NULL when there is none."""
    runs = _succeeded(run_log, "silver").where(F.col("rows_processed").isNotNull())
    latest = F.max_by("rows_processed", F.struct("finished_at", "id"))
    return runs.agg(latest.alias("rows_processed"))


def latest_fare_mae(run_log: DataFrame) -> DataFrame:
    latest = F.max_by(F.col("_metrics.mae"), F.struct("finished_at", "id"))
    return _with_metrics(run_log).agg(latest.alias("mae"))


def months_ingested(run_log: DataFrame) -> DataFrame:
    """Distinct months covered by ingest runs that landed something; malformed ranges are skipped."""
    landed = run_log.where((F.col("job_type") == "ingest") & F.col("status").isin("succeeded", "partial"))
    ranges = landed.select(F.from_json("params", schemas.RANGE_PARAMS).alias("_range")).select("_range.*")
    return expand_months(ranges).agg(F.count(F.lit(1)).alias("months_ingested"))


def list_runs(run_log: DataFrame, limit: int = C.RUNS_PAGE, offset: int = 0) -> DataFrame:
    """One page, newest first, with ``has_more``: one row past the page tells, without a count."""
    probe = run_log.orderBy(*_newest_first()).offset(offset).limit(limit + 1)
    page = Window.orderBy(*_newest_first())
    return (
        probe.withColumn("_position", F.row_number().over(page))
        .withColumn("has_more", F.max("_position").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
        .where(F.col("_position") <= limit)
        .drop("_position")
    )


def get_run(run_log: DataFrame, run_id: str) -> DataFrame:
    return run_log.where(F.col("id") == run_id)


def latest_run_per_type(run_log: DataFrame, among: int = C.LINEAGE_RUNS) -> DataFrame:
    """Latest run of each type among the newest runs only; a type not listed may have run before."""
    newest = run_log.orderBy(*_newest_first()).limit(among)
    rank = F.row_number().over(Window.partitionBy("job_type").orderBy(*_newest_first()))
    return newest.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def with_signal(run_log: DataFrame) -> DataFrame:
    """``signal`` for run lists and ``lineage_signal`` for the lineage badge."""
    status = F.col("status")
    signal = F.when(status == "succeeded", "good").when(status == "failed", "crit").otherwise("warn")
    return run_log.withColumn("signal", signal).withColumn(
        "lineage_signal", F.when(status == "cancelled", "crit").otherwise(F.col("signal"))
    )


def with_duration(run_log: DataFrame, now) -> DataFrame:
    """Whole seconds up to the finish, or to ``now`` while running; NULL when not started."""
    end = F.coalesce("finished_at", F.lit(str(now)).cast("timestamp_ntz"))
    micros = micros_between("_end", "started_at")
    seconds = F.floor(micros / 1_000_000 + 0.5)
    return (
        run_log.withColumn("_end", end)
        .withColumn("duration_seconds", F.when(F.col("started_at").isNotNull(), F.greatest(seconds, F.lit(0))))
        .drop("_end")
    )


def clear_terminal_runs(run_log: DataFrame) -> DataFrame:
    """The runs that stay when history is cleared."""
    return run_log.where(F.col("status").isin(*C.ACTIVE_STATUSES))
