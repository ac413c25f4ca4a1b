"""Footers read by a job agree with Spark's reader, and only bad files reach that reader."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import bronze
from tripstrata import schemas
from tripstrata.sources import footers, ingest


def test_types_are_those_of_the_reader(spark, tmp_path):
    spark.range(3).select(
        F.col("id").cast("tinyint").alias("a"), F.col("id").cast("smallint").alias("b"), F.col("id").cast("int").alias("c"),
        "id", F.col("id").cast("float").alias("d"), F.col("id").cast("double").alias("e"), (F.col("id") > 1).alias("f"),
        F.col("id").cast("string").alias("odd name"), F.current_date().alias("h"),
        F.timestamp_micros("id").cast("timestamp_ntz").alias("j"),
    ).coalesce(1).write.parquet(f"{tmp_path}/flat x")
    ((path, text),) = map(tuple, footers.footer_schemas(spark, [f"{tmp_path}/flat x"]).collect())
    assert T.StructType.fromJson(json.loads(text)) == spark.read.parquet(f"{tmp_path}/flat x").schema
    # The path that is handed on can be read.
    assert spark.read.parquet(path).count() == 3


def test_what_is_not_certain_is_left_to_the_reader(spark, tmp_path):
    odd = {
        "nested": pa.table({"a": [{"x": 1}]}),
        "list": pa.table({"a": [[1]]}),
        "unsigned": pa.table({"a": pa.array([1], pa.uint32())}),
        "nanos": pa.table({"a": pa.array([1], pa.timestamp("ns"))}),
        "decimal": pa.table({"a": pa.array([1], pa.decimal128(9, 2))}),
        "bytes": pa.table({"a": [b"x"]}),
    }
    for name, table in odd.items():
        pq.write_table(table, f"{tmp_path}/{name}.parquet")
    pq.write_table(pa.table({"a": pa.array([1], pa.timestamp("us"))}), f"{tmp_path}/old.parquet", use_deprecated_int96_timestamps=True)
    Path(f"{tmp_path}/torn.parquet").write_bytes(b"PAR1 torn PAR1")
    rows = footers.footer_schemas(spark, [str(tmp_path)]).collect()
    assert len(rows) == len(odd) + 2 and all(r["schema"] is None for r in rows)


def test_jobs_follow_the_bad_files(spark, tmp_path, monkeypatch):
    landing, good = f"{tmp_path}/landing", f"{tmp_path}/good"
    bronze(spark, {}).drop("period").coalesce(1).write.parquet(good)
    (file,) = Path(good).glob("*.parquet")
    for month in range(1, 13):
        folder = Path(f"{landing}/period=2024-{month:02d}")
        folder.mkdir(parents=True)
        for n in range(100):
            shutil.copyfile(file, folder / f"{n:03d}.parquet")
    bronze(spark, {}).drop("period", "extra").coalesce(1).write.parquet(f"{tmp_path}/lacking")
    (lacking,) = Path(f"{tmp_path}/lacking").glob("*.parquet")
    shutil.copyfile(lacking, f"{landing}/period=2024-02/050.parquet")
    Path(f"{landing}/period=2024-03/070.parquet").write_bytes(b"torn")
    Path(f"{landing}/period=2024-04/_ignored.parquet").write_bytes(b"torn")
    asked = []
    real = ingest._read_schema
    monkeypatch.setattr(ingest, "_read_schema", lambda s, path: asked.append(path) or real(s, path))
    rows = {r["period"]: (r["status"], r["rows"], r["reason"]) for r in ingest.ingest_bronze(spark, landing, f"{tmp_path}/lake").collect()}
    assert [path.rsplit("/", 2)[1:] for path in asked] == [["period=2024-03", "070.parquet"]]
    assert rows.pop("2024-02") == ("REJECTED", None, "Missing expected columns: ['extra']")
    assert rows.pop("2024-03")[0] == "REJECTED"
    assert len(rows) == 10 and set(rows.values()) == {("OK", 100, None)}
    assert schemas.BRONZE == T.StructType(schemas.BRONZE.fields)
