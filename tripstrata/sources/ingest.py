"""From a landing folder of monthly files to Bronze."""

from __future__ import annotations

import json
from collections import defaultdict
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from . import files, footers
from .lake import bronze_path, period_files

_FOOTERS_AT_A_TIME = 8


def schema_gate(found: T.StructType, contract: T.StructType = schemas.BRONZE) -> str | None:
    """Reason to refuse a file by its footer alone, or None. Extra columns are allowed."""
    types = {field.name: field.dataType for field in found.fields}
    missing = sorted(field.name for field in contract.fields if field.name not in types)
    if missing:
        return C.SCHEMA_MISSING.format(columns=missing)
    wrong = [
        f"{field.name}: expected {field.dataType.simpleString()}, got {types[field.name].simpleString()}"
        for field in contract.fields
        if types[field.name] != field.dataType
    ]
    return C.SCHEMA_MISMATCH.format(fields="; ".join(wrong)) if wrong else None


def _read_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Schema in the footer, None when there is no readable one."""
    try:
        return spark.read.parquet(path).schema
    except (PySparkException, Py4JJavaError):
        return None


def _gate(
    spark: SparkSession, available: dict[str, str]
) -> tuple[dict[str, T.StructType], dict[str, str]]:
    """Schema of each period's files, and the reason to refuse those of which some footer breaks the contract.

    Footers are read by a job over all files, and periods are judged by their distinct schemas. Only
    files that the job cannot vouch for are read by Spark's own reader, one by one.
    """
    schemas_of: dict[str, list[tuple[str, str | None]]] = {period: [] for period in available}
    if available:
        for row in footers.distinct_schemas(spark, list(available.values()), _period_of("path")).collect():
            schemas_of.setdefault(row["period"], []).append((row["path"], row["schema"]))
    doubtful = [path for found in schemas_of.values() for path, schema in found if schema is None]
    # A folder without data files has no footer at all.
    doubtful += [available[period] for period, found in schemas_of.items() if not found]
    with ThreadPool(_FOOTERS_AT_A_TIME) as pool:
        read = dict(zip(doubtful, pool.map(lambda path: _read_schema(spark, path), doubtful)))
    first: dict[str, T.StructType] = {}
    reasons: dict[str, str] = {}
    for period, path in available.items():
        for file, text in sorted(schemas_of[period]) or [(path, None)]:
            schema = T.StructType.fromJson(json.loads(text)) if text else read[file]
            reason = schema_gate(schema) if schema else f"unreadable file {file}"
            if reason:
                reasons[period] = reason
                break
            first.setdefault(period, schema)
    return first, reasons


def _period_of(path: str):
    return F.regexp_extract(path, r".*/(?:period=)?(\d{4}-\d{2})(?:\.parquet)?(?:/|$)", 1)


def _period_of_file():
    return _period_of("_metadata.file_path")


def _copy(spark: SparkSession, schema: T.StructType, group: dict[str, str], root: str) -> dict[str, tuple]:
    """Write the periods of one schema; results by period."""
    try:
        raw = spark.read.schema(schema).parquet(*group.values())
        rows = raw.withColumn("period", _period_of_file())
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("period").parquet(bronze_path(root))
        # Selects no data column, so only footers are read.
        counts = dict(raw.groupBy(_period_of_file()).count().collect())
    except (PySparkException, Py4JJavaError):
        periods = list(group)
        if len(periods) == 1:
            return {periods[0]: ("REJECTED", f"unreadable data in {group[periods[0]]}")}
        results: dict[str, tuple] = {}
        for half in (periods[: len(periods) // 2], periods[len(periods) // 2 :]):
            results |= _copy(spark, schema, {period: group[period] for period in half}, root)
        return results
    results = {}
    for period in group:
        partition = f"{bronze_path(root)}/period={period}"
        if not counts.get(period) and files.exists(spark, partition):
            files.delete(spark, partition)
        results[period] = ("OK", None, counts.get(period, 0), partition)
    return results


def ingest_bronze(
    spark: SparkSession, landing: str, root: str, periods: list[str] | None = None
) -> DataFrame:
    """Copy each period's files to Bronze if their schemas hold; a bad period stops no other.

    Footers are read in one job, data in one job per distinct schema, which is one job unless files carry
    extra columns. Should a job fail on damaged pages, its periods are tried in halves, so
    the damaged ones are found and the others land. Files are copied as they are, NaN included.
    """
    available = period_files(spark, landing)
    wanted = sorted(available) if periods is None else periods
    present = [period for period in wanted if period in available]
    found_schemas, reasons = _gate(spark, {period: available[period] for period in present})
    results: dict[str, tuple] = {}
    by_schema: dict[str, dict[str, str]] = defaultdict(dict)
    for period in wanted:
        if period not in available:
            results[period] = ("UNAVAILABLE", f"no raw file for {period} in {landing}")
            continue
        if period in reasons:
            results[period] = ("REJECTED", reasons[period])
        else:
            by_schema[found_schemas[period].json()][period] = available[period]

    for text, group in by_schema.items():
        results |= _copy(spark, T.StructType.fromJson(json.loads(text)), group, root)

    rows = [(period, *(verdict + (None, None))[:4]) for period, verdict in sorted(results.items())]
    return spark.createDataFrame(rows, schemas.INGEST_RESULT)


def ingest_rollup(results: DataFrame) -> DataFrame:
    """Status of the whole ingest: succeeded without failures, failed without successes, else partial."""
    ok = F.col("status") == "OK"
    failure = F.format_string("%s: %s (%s)", "period", "status", "reason")
    failures = F.sort_array(F.collect_list(F.when(~ok, F.struct("period", failure.alias("text")))))
    counted = results.agg(
        F.count_if(ok).alias("_ok"),
        F.count_if(~ok).alias("_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("_rows"),
        F.array_join(F.transform(failures, lambda f: f["text"]), "; ").alias("_errors"),
    )
    status = F.when(F.col("_failed") == 0, "succeeded").when(F.col("_ok") == 0, "failed").otherwise("partial")
    return counted.select(
        status.alias("status"),
        F.when(F.col("_failed") > 0, F.col("_errors")).alias("error"),
        F.when(status != "failed", F.col("_rows")).alias("rows_processed"),
    )
