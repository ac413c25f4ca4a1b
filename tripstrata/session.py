"""Session settings and the folder that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Large scan splits keep the number of files a partitioned write leaves behind low.
    "spark.sql.files.maxPartitionBytes": "512m",
    # A task that writes a handful of partitions keeps their files open instead of sorting its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

# Adaptive execution merges small shuffle partitions but never splits large ones, so a cluster starts
# with many. Set the option yourself to choose another number.
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
CLUSTER_SHUFFLE_PARTITIONS = "16384"


def build_session(app: str = "tripstrata", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local") and spark.conf.get(_INITIAL_PARTITIONS, None) is None:
        spark.conf.set(_INITIAL_PARTITIONS, CLUSTER_SHUFFLE_PARTITIONS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a scratch folder of its own. On a
    cluster a machine-local folder would vanish with the machine, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tripstrata-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, and gives the planner a true size, so a join
    against it is broadcast only when the files are small enough.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
