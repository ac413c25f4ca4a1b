"""The lake's folders: where each layer lies, how it is read, written, measured and cleared.

    bronze/period=YYYY-MM
    silver/outcome=<accepted or category>/period=YYYY-MM
    quality_report
    gold/<table>

Silver and quarantine share one folder, split by outcome: one pass over Bronze writes both.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from ..operators.gold import gold_order
from ..operators.silver import nan_to_null
from . import files

_PERIOD_NAME = re.compile(r"^(?:period=)?(\d{4})-(\d{2})(?:\.parquet)?$")


def bronze_path(root: str) -> str:
    return f"{root}/bronze"


def silver_path(root: str) -> str:
    return f"{root}/silver"


def gold_path(root: str, name: str) -> str:
    return f"{root}/gold/{name}"


def layers(root: str) -> dict[str, list[str]]:
    """Folders of the seven layers that the inventory shows."""
    return {
        "bronze": [bronze_path(root)],
        "silver": [f"{silver_path(root)}/outcome={C.ACCEPTED}"],
        "silver-quarantine": [f"{silver_path(root)}/outcome={name}" for name in C.CATEGORIES],
        **{f"gold-{name.replace('_', '-')}": [gold_path(root, name)] for name in C.GOLD_TABLES},
    }


# --- Periods ----------------------------------------------------------------------------------


def period_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Period and path of each monthly file or partition in a folder."""
    found = {}
    for name in files.children(spark, path):
        match = _PERIOD_NAME.match(name)
        if match:
            found["-".join(match.groups())] = f"{path}/{name}"
    return found


def list_periods(spark: SparkSession, path: str) -> DataFrame:
    """(year, month) of a landing folder or of Bronze, in order."""
    periods = [tuple(int(part) for part in period.split("-")) for period in period_files(spark, path)]
    return spark.createDataFrame(sorted(periods), "year int, month int")


def periods_of(trips: DataFrame) -> DataFrame:
    """(year, month) of the periods that rows belong to."""
    split = F.split("period", "-")
    return (
        trips.select("period")
        .distinct()
        .select(split[0].cast("int").alias("year"), split[1].cast("int").alias("month"))
        .orderBy("year", "month")
    )


# --- Reading ----------------------------------------------------------------------------------


def load_bronze(spark: SparkSession, root: str) -> DataFrame:
    return nan_to_null(spark.read.schema(schemas.BRONZE_TABLE).parquet(bronze_path(root)))


def load_routed(spark: SparkSession, root: str) -> DataFrame:
    """Accepted and excluded rows together, with ``outcome``."""
    return spark.read.schema(schemas.ROUTED_TABLE).parquet(silver_path(root))


def load_silver(spark: SparkSession, root: str) -> DataFrame:
    """Accepted rows of every period; only their folder is listed. Without it there are none."""
    base = silver_path(root)
    if not files.exists(spark, f"{base}/outcome={C.ACCEPTED}"):
        return spark.createDataFrame([], schemas.ROUTED_TABLE).drop("outcome")
    reader = spark.read.schema(schemas.ROUTED_TABLE).option("basePath", base)
    return reader.parquet(f"{base}/outcome={C.ACCEPTED}").drop("outcome")


def load_quarantine(spark: SparkSession, root: str) -> DataFrame:
    rows = load_routed(spark, root).where(F.col("outcome") != C.ACCEPTED)
    return rows.drop(*schemas.FLAGS.names).withColumnRenamed("outcome", "rule")


def read_gold(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Gold or feature table in its order; a table not written yet is empty, not an error."""
    schema, path = schemas.GOLD[name], gold_path(root, name)
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).orderBy(*gold_order(name))


def silver_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """``(period, fingerprint)`` of the accepted rows' files: names, sizes and times, which a rewrite changes."""
    files_ = lake_objects(spark, {"silver": [f"{silver_path(root)}/outcome={C.ACCEPTED}"]})
    period = F.regexp_extract("path", r"/period=(\d{4}-\d{2})/", 1)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    grouped = files_.groupBy(period.alias("period")).agg(F.bit_xor(one).alias("_files"), F.count(F.lit(1)).alias("_n"))
    return grouped.where("period <> ''").select("period", F.format_string("%d-%d", "_n", "_files").alias("fingerprint"))


# --- Writing ----------------------------------------------------------------------------------


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*columns).parquet(path)


def write_routed(routed: DataFrame, root: str) -> set[tuple[str, str]]:
    """Store every row once, in the partition of its outcome and period; returns those partitions.

    No shuffle: input splits lie within a period, so a task writes a few files at most. Rows of a file
    are in the order of their pickup, so a reader of few days skips most row groups; the write would sort
    rows by partition anyway, so this is the same sort with a longer key. The partitions are observed
    while rows are written, one entry per outcome and period.
    """
    written = Observation()
    key = F.collect_set(F.struct("outcome", "period")).alias("partitions")
    ordered = routed.observe(written, key).sortWithinPartitions("outcome", "period", C.PICKUP)
    overwrite_partitions(ordered, silver_path(root), "outcome", "period")
    return {(row["outcome"], row["period"]) for row in written.get.get("partitions", [])}


def write_silver(routed: DataFrame, root: str) -> None:
    write_routed(routed.where(F.col("outcome") == C.ACCEPTED), root)


def write_quarantine(routed: DataFrame, root: str) -> None:
    write_routed(routed.where(F.col("outcome") != C.ACCEPTED), root)


def drop_unwritten(spark: SparkSession, root: str, written: set[tuple[str, str]], periods: list[str]) -> None:
    """Remove the outcome partitions of ``periods`` that the last write had no rows for.

    Overwriting replaces the partitions that have rows. One that an earlier run filled and this run
    left empty would keep the old ones.
    """
    for outcome in (C.ACCEPTED, *C.CATEGORIES):
        folder = f"{silver_path(root)}/outcome={outcome}"
        for name in files.children(spark, folder):
            period = name.removeprefix("period=")
            if period in periods and (outcome, period) not in written:
                files.delete(spark, f"{folder}/{name}")


def write_quality_report(report: DataFrame, root: str) -> None:
    """One JSON object per period, one per line. A run reports on every period of Bronze."""
    rows = report.repartition(1).sortWithinPartitions("period")
    rows.write.mode("overwrite").json(f"{root}/quality_report")


def read_quality_report(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.QUALITY_REPORT).json(f"{root}/quality_report").orderBy("period")


def write_gold(table: DataFrame, root: str, name: str) -> str:
    """Overwrite one small table as a single sorted file.

    ``repartition(1)`` moves the finished rows only; ``coalesce(1)`` would pull the final
    aggregation over all partial results into one task.
    """
    path = gold_path(root, name)
    rows = table.select(*schemas.GOLD[name].names)
    rows.repartition(1).sortWithinPartitions(*gold_order(name)).write.mode("overwrite").parquet(path)
    return path


KEPT_VERSIONS = 2


def _quoted(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _name_parts(spark: SparkSession, name: str) -> tuple[str, str]:
    """Database and table of a name, quoted or not."""
    parts = [quoted.replace("``", "`") or plain for quoted, plain in re.findall(r"`((?:[^`]|``)+)`|([^.`]+)", name)]
    return (parts[-2] if len(parts) > 1 else spark.catalog.currentDatabase()), parts[-1].lower()


def versions_path(spark: SparkSession, name: str) -> str:
    database, table = _name_parts(spark, name)
    return f"{spark.catalog.getDatabase(_quoted(database)).locationUri.rstrip('/')}/_versions/{table}"


def table_versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a published table, oldest first."""
    return files.children(spark, versions_path(spark, name))


def published_version(spark: SparkSession, name: str) -> str | None:
    """The version that readers of the name see; None where there is none."""
    full = _quoted(*_name_parts(spark, name))
    if not spark.catalog.tableExists(full):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {full}").where("col_name = 'Location'").first()
    version = described["data_type"].rstrip("/").rsplit("/", 1)[1] if described else None
    return version if version in table_versions(spark, name) else None


def write_version(df: DataFrame, name: str, grain: tuple[str, ...] | list[str] = ()) -> str:
    """Store a complete version beside the published one, which stays; returns the version.

    A key of ``grain`` that occurs twice fails the write itself: rows are grouped by their key on the
    way, so the check costs no second pass, and a hot key is folded before the shuffle.
    """
    spark, keys = df.sparkSession, list(grain)
    version = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    path = f"{versions_path(spark, name)}/{version}"
    message = f"{name} has more than one row for a key of {keys}"
    if keys:
        others = [F.col(_quoted(c)) for c in df.columns if c not in keys]
        row = F.first(F.struct(F.lit(0).alias("_"), *others)).alias("_row")
        grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), row)
        single = F.when(F.col("_n") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
        columns = [F.col(_quoted(c)) if c in keys else F.col(f"_row.{_quoted(c)}").alias(c) for c in df.columns]
        df = grouped.where(single).select(*columns)
    try:
        df.write.parquet(path)
    except Exception as problem:
        files.delete(spark, path)
        if keys and message in str(problem):
            raise ValueError(message) from problem
        raise
    return version


def point_to(spark: SparkSession, name: str, version: str) -> None:
    """Let the name stand for a version: one change of the catalog, so readers see the old or the new.

    Only where the columns change the table has to be made anew, and there is a moment without it.
    """
    full, path = _quoted(*_name_parts(spark, name)), f"{versions_path(spark, name)}/{version}"
    if spark.catalog.tableExists(full):
        if spark.table(full).schema == spark.read.parquet(path).schema:
            spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
            return
        spark.sql(f"DROP TABLE {full}")
    spark.sql(f"CREATE TABLE {full} USING parquet LOCATION '{path}'")


def drop_old_versions(spark: SparkSession, name: str, keep: int = KEPT_VERSIONS) -> list[str]:
    """Delete the versions that readers can no longer be in: all but the published one and the ``keep``
    - 1 before it. What attempts that died left behind goes too."""
    current, versions = published_version(spark, name), table_versions(spark, name)
    if current is None:
        return []
    place = versions.index(current)
    spared = set(versions[max(place - keep + 1, 0) : place + 1])
    dropped = [version for version in versions if version not in spared]
    for version in dropped:
        files.delete(spark, f"{versions_path(spark, name)}/{version}")
    return dropped


def drop_published(spark: SparkSession, name: str) -> bool:
    """Remove a published table with all its versions; false when there was none."""
    full = _quoted(*_name_parts(spark, name))
    there = spark.catalog.tableExists(full)
    if there:
        spark.sql(f"DROP TABLE {full}")
    files.delete(spark, versions_path(spark, name))
    return there


def publish_table(
    df: DataFrame,
    name: str,
    jdbc: dict[str, str] | None = None,
    grain: tuple[str, ...] | list[str] = (),
    keep: int = KEPT_VERSIONS,
) -> None:
    """Replace the contents of a catalog table, or of a JDBC table; NaN becomes NULL.

    The catalog table points to one stored version. A new version is written and checked beside it, then
    the table's location is changed in one step, then versions older than the ``keep`` newest are
    deleted: readers always find a complete table, an attempt that fails or dies leaves the old one, and
    a reader that has begun keeps its files for ``keep`` - 1 publishes. One writer for each name. A JDBC
    table is truncated and filled by the connector, which is as atomic as the database makes it.
    """
    rows = nan_to_null(df)
    if jdbc:
        rows.write.format("jdbc").options(**jdbc, dbtable=name, truncate="true").mode("overwrite").save()
        return
    spark = df.sparkSession
    point_to(spark, name, write_version(rows, name, grain))
    drop_old_versions(spark, name, keep)


def export_csv(df: DataFrame, path: str) -> None:
    """Header, doubled quotes, empty field for NULL, values as stored.

    Lines end in LF: with CRLF the writer would also change line feeds inside values.
    """
    options = {
        "header": "true",
        "escape": '"',
        "nullValue": "",
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    df.write.mode("overwrite").options(**options).csv(path)


# --- Measuring and clearing -------------------------------------------------------------------

_OBJECTS = "layer string, path string, length bigint, modificationTime timestamp"


def lake_objects(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """Data files under each layer's folders; names starting with ``_`` and folders are left out."""
    found = []
    for layer, paths in folders.items():
        present = [path for path in paths if files.exists(spark, path)]
        if present:
            listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(present)
            found.append(listing.select(F.lit(layer).alias("layer"), "path", "length", "modificationTime"))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], _OBJECTS))


def lake_inventory(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """Objects and bytes per layer, with the times of its oldest and newest object.

    A layer without a folder is listed as empty. The objects themselves are rows of
    ``lake_objects``: as one list per layer they would have to fit in one task.
    """
    names = spark.createDataFrame([(layer,) for layer in folders], "layer string")
    grouped = lake_objects(spark, folders).groupBy("layer").agg(
        F.count(F.lit(1)).alias("object_count"),
        F.sum("length").alias("total_bytes"),
        F.min("modificationTime").alias("oldest"),
        F.max("modificationTime").alias("newest"),
    )
    return names.join(grouped, "layer", "left").fillna(0, ["object_count", "total_bytes"])


def storage_stats(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """Parquet files, bytes, rows and bytes per row of each layer. Rows come from file footers."""
    sizes = (
        lake_objects(spark, folders)
        .where(F.col("path").endswith(".parquet"))
        .groupBy("layer")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes"))
    )
    counted = []
    for layer, paths in folders.items():
        present = [path for path in paths if files.exists(spark, path)]
        if present:
            rows = spark.read.schema(T.StructType()).option("recursiveFileLookup", "true").parquet(*present)
            counted.append(rows.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("layer", F.lit(layer)))
    empty = spark.createDataFrame([], "total_rows bigint, layer string")
    rows = reduce(DataFrame.unionByName, counted, empty)
    names = spark.createDataFrame([(layer,) for layer in folders], "layer string")
    totals = names.join(sizes, "layer", "left").join(rows, "layer", "left")
    totals = totals.fillna(0, ["file_count", "total_bytes", "total_rows"])
    per_row = F.when(F.col("total_rows") > 0, F.round(F.col("total_bytes") / F.col("total_rows"), 2))
    return totals.select("layer", "file_count", "total_bytes", "total_rows", per_row.alias("bytes_per_row"))


def reset_layers(spark: SparkSession, root: str, database: str | None = None) -> DataFrame:
    """Clear the layers and the published tables that exist, and say how much was there.

    Folders count their direct children; the online snapshot counts its keys.
    """
    done = []
    online = f"{root}/online_features"
    keys = spark.read.parquet(online).count() if files.exists(spark, online) else 0
    for layer in ("bronze", "silver", "gold"):
        path = f"{root}/{layer}"
        done.append(("folder", layer, len(files.children(spark, path))))
        files.delete(spark, path)
    files.delete(spark, online)
    # Both are derived from what was just cleared.
    for derived in ("trip_rollup", "quality_report"):
        files.delete(spark, f"{root}/{derived}")
    done.append(("online", "features", keys))
    if database and spark.catalog.databaseExists(database):
        for name in (*C.GOLD_TABLES, C.FEATURE_TABLE):
            if drop_published(spark, _quoted(database, name)):
                done.append(("table", name, 1))
    return spark.createDataFrame(done, "kind string, name string, removed bigint")
