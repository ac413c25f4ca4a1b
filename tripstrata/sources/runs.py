"""The run log as a table: one row per finished run, appended by the pipeline's stages."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.runlog import clear_terminal_runs
from . import files


def runs_path(root: str) -> str:
    return f"{root}/job_runs"


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs; a log not written yet is empty."""
    if not files.exists(spark, runs_path(root)):
        return spark.createDataFrame([], schemas.RUN_LOG)
    return spark.read.schema(schemas.RUN_LOG).parquet(runs_path(root))


def now() -> datetime:
    """The time of day in UTC, without a zone, as the log keeps it."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def append_run(
    spark: SparkSession,
    root: str,
    job_type: str,
    status: str,
    started: datetime,
    params: dict[str, Any] | None = None,
    rows: int | None = None,
    error: str | None = None,
    metrics: dict[str, float] | None = None,
) -> str:
    """Add one finished run and return its id."""
    run_id = uuid.uuid4().hex
    row = {
        "id": run_id,
        "job_type": job_type,
        "status": status,
        "params": json.dumps(params or {}),
        "submitted_at": started,
        "started_at": started,
        "finished_at": now(),
        "exit_code": 1 if status == "failed" else 0,
        "error": error,
        "log_output": None,
        "rows_processed": rows,
        "metrics": json.dumps(metrics) if metrics else None,
    }
    one = spark.createDataFrame([tuple(row[name] for name in schemas.RUN_LOG.names)], schemas.RUN_LOG)
    one.coalesce(1).write.mode("append").parquet(runs_path(root))
    return run_id


def clear_runs(spark: SparkSession, root: str) -> int:
    """Forget finished runs and return how many there were. What stays is written beside the log first."""
    log = read_runs(spark, root)
    kept = clear_terminal_runs(log)
    removed = log.count() - kept.count()
    if removed:
        beside = f"{runs_path(root)}-kept"
        kept.write.mode("overwrite").parquet(beside)
        spark.read.schema(schemas.RUN_LOG).parquet(beside).write.mode("overwrite").parquet(runs_path(root))
        files.delete(spark, beside)
    return removed
