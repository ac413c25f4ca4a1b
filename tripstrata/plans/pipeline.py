"""The pipeline's stages from stored input to stored output."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..operators import model as fares
from ..operators.features import publish_online, zone_hour_features
from ..operators.gold import BUILDERS, ROLLUP_KEYS, trip_rollup
from ..operators.silver import quality_report, with_outcome
from ..functions.times import month_range
from ..sources import files, lake, runs
from ..sources.ingest import ingest_bronze, ingest_rollup


def run_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    periods: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Ingest the given periods, the months from ``start`` to ``end``, or all that have landed."""
    if periods is None and start and end:
        periods = [row["period"] for row in month_range(spark, start, end).collect()]
    return ingest_bronze(spark, landing, root, periods)


_GRAINS = {
    "daily_revenue": ["pickup_date"],
    "hourly_demand": ["pickup_hour"],
    "zone_stats": [C.PICKUP_ZONE],
    "congestion_metrics": ["pickup_date"],
    C.FEATURE_TABLE: [C.PICKUP_ZONE, "pickup_hour"],
}


def run_silver(spark: SparkSession, root: str) -> DataFrame:
    """Bronze to Silver, quarantine and quality report, all periods in one pass.

    The report is counted from what was stored: that reads a few columns, not the rules again.
    """
    periods = list(lake.period_files(spark, lake.bronze_path(root)))
    if not periods:  # nothing ingested: an empty report
        return spark.createDataFrame([], schemas.QUALITY_REPORT)
    written = lake.write_routed(with_outcome(lake.load_bronze(spark, root)), root)
    lake.drop_unwritten(spark, root, written, periods)
    # Periods that left Bronze since an earlier run are no part of this one; their folders are pruned.
    stored = lake.load_routed(spark, root).where(F.col("period").isin(periods))
    lake.write_quality_report(quality_report(stored), root)
    return lake.read_quality_report(spark, root)


def refresh_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Additive totals per date, hour, zone and flag: the only reading of Silver for Gold and features.

    Totals are kept by period beside the fingerprint of the Silver files they were summed from. Periods
    whose files are the same are not read again; changed ones are summed and replaced, and those that
    left Silver are dropped. Fingerprints are taken before the reading and stored after it, so a run that
    dies, or a period that changes meanwhile, is summed again by the next.
    """
    path, silver = f"{root}/trip_rollup", lake.load_silver(spark, root)
    state, layout = f"{path}/_state", trip_rollup(silver, "period", *ROLLUP_KEYS).schema
    now = {row["period"]: row["fingerprint"] for row in lake.silver_fingerprints(spark, root).collect()}
    before: dict[str, str] = {}
    if files.exists(spark, f"{state}/_SUCCESS"):
        before = {row["period"]: row["fingerprint"] for row in spark.read.parquet(state).collect()}
    elif files.exists(spark, path):  # totals of unknown origin
        files.delete(spark, path)
    present = {name.removeprefix("period=") for name in files.children(spark, path)}
    changed = sorted(p for p, fingerprint in now.items() if before.get(p) != fingerprint or p not in present)
    for gone in present & (set(before) - set(now)):
        files.delete(spark, f"{path}/period={gone}")
    if changed:
        lake.overwrite_partitions(_rollup_of(silver, changed), path, "period")
    if now != before:
        rows = spark.createDataFrame(sorted(now.items()), "period string, fingerprint string")
        rows.coalesce(1).write.mode("overwrite").parquet(state)
    if not now:
        return spark.createDataFrame([], layout).drop("period")
    return spark.read.schema(layout).parquet(path).drop("period")


def _rollup_of(silver: DataFrame, periods: list[str]) -> DataFrame:
    """Totals of some periods; the list prunes the partitions that are read."""
    return trip_rollup(silver.where(F.col("period").isin(periods)), "period", *ROLLUP_KEYS)


def run_gold(
    spark: SparkSession, root: str, database: str | None = None, rollup: DataFrame | None = None
) -> list[dict[str, str]]:
    """The four Gold tables in order; the first failure stops the batch.

    The published copy is read from the written files, not computed again.
    """
    source = rollup if rollup is not None else refresh_rollup(spark, root)
    done = []
    for name, build in BUILDERS.items():
        path = lake.write_gold(build(source), root, name)
        if database:
            table = lake.read_gold(spark, root, name)
            lake.publish_table(table, f"`{database}`.`{name}`", grain=_GRAINS[name])
        done.append({"job": name, "path": path})
    return done


def run_features(
    spark: SparkSession, root: str, database: str | None = None, rollup: DataFrame | None = None
) -> dict[str, int | str]:
    """The feature table and its key/JSON snapshot, written as tables."""
    source = rollup if rollup is not None else refresh_rollup(spark, root)
    lake.write_gold(zone_hour_features(source), root, C.FEATURE_TABLE)
    features = lake.read_gold(spark, root, C.FEATURE_TABLE)
    if database:
        lake.publish_table(features, f"`{database}`.`{C.FEATURE_TABLE}`", grain=_GRAINS[C.FEATURE_TABLE])
    online = f"{root}/online_features"
    publish_online(features).write.mode("overwrite").parquet(online)
    return {
        "feature_rows": features.count(),
        "table": C.FEATURE_TABLE,
        "online_keys": spark.read.parquet(online).count(),
    }


def run_training(spark: SparkSession, root: str, n: int | None = C.MODEL_SAMPLE_ROWS) -> dict:
    model, result = fares.train_fare_model(lake.load_silver(spark, root), n)
    return {"run_id": fares.log_run(spark, root, model, result), **result}


@contextmanager
def logged(spark: SparkSession, root: str, job_type: str, params: dict | None = None) -> Iterator[dict]:
    """Run a stage under the run log. The block may set ``status``, ``rows``, ``error``, ``metrics`` and
    ``params`` in the dict it is given; an exception is logged as a failed run and goes on."""
    facts: dict = {"status": "succeeded", "params": params}
    started = runs.now()
    try:
        yield facts
    except Exception as problem:
        facts |= {"status": "failed", "error": str(problem)}
        raise
    finally:
        runs.append_run(spark, root, job_type, started=started, **facts)


def run_all(
    spark: SparkSession,
    landing: str,
    root: str,
    database: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> dict:
    """Ingest to training; Gold and features share one rollup of Silver. Every stage is logged."""
    with logged(spark, root, "ingest") as facts:
        ingested = run_ingest(spark, landing, root, start=start, end=end)
        summary = ingested.agg(F.min("period").alias("start"), F.max("period").alias("end")).first()
        total = ingest_rollup(ingested).first()
        facts |= {"status": total["status"], "rows": total["rows_processed"], "error": total["error"]}
        facts["params"] = {"start": start or summary["start"], "end": end or summary["end"]}
    with logged(spark, root, "silver") as facts:
        report = run_silver(spark, root)
        facts["rows"] = report.agg(F.sum("records_processed")).first()[0]
    rollup = refresh_rollup(spark, root)
    with logged(spark, root, "gold"):
        tables = run_gold(spark, root, database, rollup)
    with logged(spark, root, "features") as facts:
        built = run_features(spark, root, database, rollup)
        facts["rows"] = built["feature_rows"]
    with logged(spark, root, "train") as facts:
        trained = run_training(spark, root)
        facts |= {"rows": trained["rows"], "metrics": {name: trained[name] for name in ("mae", "rmse", "r2")}}
        facts["params"] = {"sample_limit": trained["sample_limit"]}
    return {
        "ingest": ingested,
        "quality_report": report,
        "gold": tables,
        "features": built,
        "training": trained,
    }

