"""Fare regression with Spark ML: sample, split, fit, measure, log, load, score."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..session import shared_dir
from ..sources import files
from . import trees


def with_pickup_hour(trips: DataFrame) -> DataFrame:
    return trips.withColumn("pickup_hour", F.hour(C.PICKUP))


def training_rows(silver: DataFrame) -> DataFrame:
    """The five features and the target of trips that have all six."""
    return with_pickup_hour(silver).select(*C.MODEL_FEATURES, C.MODEL_TARGET).dropna()


def _row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of a row's values (numbers to 1e-8) and the seed; the same wherever it is computed."""
    values = []
    for column in df.columns:
        units = F.rint(F.col(f"`{column}`").cast("double") * F.lit(1e8))
        # Beyond a long the double stands for itself.
        values.append(F.coalesce(units.try_cast("bigint").cast("string"), units.cast("string"), F.lit("-")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *values))


def _share(row_hash: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a hash."""
    return F.conv(F.substring(row_hash, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


# 16 ** 3 counts at most reach the driver.
_COUNTED_DIGITS = 3


def bounded_sample(df: DataFrame, n: int = C.MODEL_SAMPLE_ROWS, seed: int = C.MODEL_SEED) -> DataFrame:
    """All rows when there are at most ``n``, else exactly ``n``: those with the smallest row hashes.

    The choice depends on values and seed only, not on partitions or retries. One pass counts rows by the
    first digits of their hash, which gives the total and the last beginning that is needed; a second takes
    the rows up to it, where the data is, and only those are ordered.
    """
    hashed = df.withColumn("_hash", _row_hash(df, seed))
    start = F.substring("_hash", 1, _COUNTED_DIGITS)
    counts = hashed.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n")).orderBy("start").collect()
    if sum(row["n"] for row in counts) <= n:
        return df
    found, last = 0, ""
    for row in counts:
        found, last = found + row["n"], row["start"]
        if found >= n:
            break
    return hashed.where(start <= last).orderBy("_hash").limit(n).drop("_hash")


def train_test_split(
    df: DataFrame, test_share: float = C.MODEL_TEST_SHARE, seed: int = C.MODEL_SEED
) -> tuple[DataFrame, DataFrame]:
    """Disjoint training and test rows by a hash of their values and the seed. Equal rows are on the
    same side, and a row keeps its side however the data is partitioned."""
    share = _share(_row_hash(df, seed + 1))
    return df.where(share >= test_share), df.where(share < test_share)


def forest() -> Pipeline:
    assembler = VectorAssembler(inputCols=list(C.MODEL_FEATURES), outputCol="features", handleInvalid="keep")
    regressor = RandomForestRegressor(
        featuresCol="features",
        labelCol=C.MODEL_TARGET,
        predictionCol="prediction",
        numTrees=C.MODEL_TREES,
        maxDepth=C.MODEL_DEPTH,
        seed=C.MODEL_SEED,
        maxMemoryInMB=C.MODEL_PASS_MEMORY_MB,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[assembler, regressor])


def regression_metrics(
    scored: DataFrame, label: str = C.MODEL_TARGET, prediction: str = "prediction"
) -> DataFrame:
    """MAE, RMSE and R2 in one aggregation."""
    error = F.col(label) - F.col(prediction)
    spread = F.var_pop(label) * F.count(label)
    return scored.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"),
    )


def train_fare_model(silver: DataFrame, n: int | None = C.MODEL_SAMPLE_ROWS) -> tuple[PipelineModel, dict]:
    """Fitted model, and its metrics on held-out rows; ``n=None`` trains on every complete trip.

    The sample is spread again, since a limit leaves it in one partition, and checkpointed, so that
    a lost executor cannot change which rows are in it.
    """
    spark, rows, started = silver.sparkSession, training_rows(silver), datetime.now(timezone.utc)
    shared_dir(spark)
    sample = rows if n is None else bounded_sample(rows, n).repartition(spark.sparkContext.defaultParallelism)
    sample = sample.checkpoint()
    train, test = train_test_split(sample)
    model = forest().fit(train)
    metrics = regression_metrics(model.transform(test)).first().asDict()
    return model, {**metrics, "rows": sample.count(), "sample_limit": n, "started_at": started}


def log_run(spark: SparkSession, root: str, model: PipelineModel, result: dict) -> str:
    """Save the model and its table of nodes under a new run id, then append parameters and metrics to the
    runs table, which makes the run known: one that fails before leaves no run.

    A run counts from ``result["started_at"]``, the time before the fit; now, if that is missing.
    """
    run_id = uuid.uuid4().hex
    path = f"{root}/models/{run_id}"
    model.save(path)
    # A model has no more nodes than its trees and depth allow, whatever it was fitted on.
    trees.stored_nodes(spark, path).coalesce(1).sortWithinPartitions("tree", "node").write.parquet(nodes_path(root, run_id))
    params = {
        "trees": C.MODEL_TREES,
        "depth": C.MODEL_DEPTH,
        "seed": C.MODEL_SEED,
        "features": ",".join(C.MODEL_FEATURES),
        "sample_limit": result.get("sample_limit"),
    }
    metrics = {name: result[name] for name in ("mae", "rmse", "r2")}
    started = result.get("started_at") or datetime.now(timezone.utc)
    row = (run_id, started, path, json.dumps(params), json.dumps(metrics), result["rows"])
    runs = spark.createDataFrame([row], schemas.MODEL_RUNS)
    runs.coalesce(1).write.mode("append").parquet(f"{root}/model_runs")
    return run_id


def nodes_path(root: str, run_id: str) -> str:
    return f"{root}/model_nodes/run_id={run_id}"


def latest_run(spark: SparkSession, root: str) -> Row:
    """The most recently started run; of runs that started together, the one with the greatest id."""
    path = f"{root}/model_runs"
    newest = None
    if files.exists(spark, path):
        runs = spark.read.schema(schemas.MODEL_RUNS).parquet(path)
        newest = runs.agg(F.max_by(F.struct("*"), F.struct("started_at", "run_id")).alias("run")).first()["run"]
    if newest is None:
        raise LookupError(f"no trained model under {root}; run the training first")
    return newest


def latest_model(spark: SparkSession, root: str) -> PipelineModel:
    """The model of the latest run."""
    return PipelineModel.load(latest_run(spark, root)["model_path"])


def latest_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The latest run's table of nodes, as ``trees.walk`` takes it."""
    return spark.read.parquet(nodes_path(root, latest_run(spark, root)["run_id"]))


def score_fares(model: PipelineModel, trips: DataFrame, decimals: int | None = None) -> DataFrame:
    """Trips with ``predicted_fare``; trips need the five features or a pickup time."""
    rows = trips if "pickup_hour" in trips.columns else with_pickup_hour(trips)
    scored = model.transform(rows).drop("features")
    fare = F.col("prediction") if decimals is None else F.round("prediction", decimals)
    return scored.withColumn("predicted_fare", fare).drop("prediction")
