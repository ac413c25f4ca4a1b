from __future__ import annotations

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import write_landing
from tests.helpers import BASE, bronze
from tripstrata import constants as C
from tripstrata import schemas
from tripstrata.operators import gold, runlog, silver
from tripstrata.plans import pipeline
from tripstrata.sources import adapters, files, lake, runs
from tripstrata.sources.ingest import ingest_bronze, ingest_rollup, schema_gate


def _land(df, landing, period):
    df.drop("period").coalesce(1).write.mode("overwrite").parquet(f"{landing}/{period}.parquet")


def _statuses(results):
    return {row.period: (row.status, row.rows) for row in results.collect()}


def test_schema_gate():
    fields = schemas.BRONZE.fields
    assert schema_gate(schemas.BRONZE) is None
    extra = type(schemas.BRONZE)([*fields, schemas.PERIOD])
    assert schema_gate(extra) is None
    missing = type(schemas.BRONZE)([f for f in fields if f.name not in ("VendorID", "Airport_fee")])
    assert schema_gate(missing) == "Missing expected columns: ['Airport_fee', 'VendorID']"
    wide = type(schemas.BRONZE)([type(f)(f.name, schemas._LONG) if f.name in ("VendorID", "extra") else f for f in fields])
    assert schema_gate(wide) == "Dtype mismatch: VendorID: expected int, got bigint; extra: expected double, got bigint"


def test_ingest_gates_each_period(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    rows = bronze(spark, {}, {})
    _land(rows, landing, "2024-01")
    _land(rows.drop("Airport_fee"), landing, "2024-02")
    _land(rows.withColumn("VendorID", F.col("VendorID").cast("bigint")), landing, "2024-03")
    _land(rows.withColumn("extra_note", F.lit("kept")), landing, "2024-04")
    _land(rows.where("false"), landing, "2024-06")
    Path(f"{landing}/2024-07.parquet").write_bytes(b"not parquet")
    results = ingest_bronze(spark, landing, root, [f"2024-0{n}" for n in range(1, 8)])
    assert _statuses(results) == {
        "2024-01": ("OK", 2),
        "2024-02": ("REJECTED", None),
        "2024-03": ("REJECTED", None),
        "2024-04": ("OK", 2),
        "2024-05": ("UNAVAILABLE", None),
        "2024-06": ("OK", 0),
        "2024-07": ("REJECTED", None),
    }
    stored = lake.load_bronze(spark, root)
    assert dict(stored.groupBy("period").count().collect()) == {"2024-01": 2, "2024-04": 2}
    assert "extra_note" in spark.read.parquet(f"{root}/bronze/period=2024-04").columns
    rollup = ingest_rollup(results).first()
    assert (rollup.status, rollup.rows_processed) == ("partial", 4)
    assert rollup.error.startswith("2024-02: REJECTED (Missing expected columns: ['Airport_fee']); 2024-03: REJECTED")

    again = ingest_bronze(spark, landing, root, ["2024-01"])
    assert _statuses(again) == {"2024-01": ("OK", 2)}
    assert lake.load_bronze(spark, root).count() == 4
    assert [tuple(r) for r in lake.list_periods(spark, f"{root}/bronze").collect()] == [(2024, 1), (2024, 4)]
    assert lake.list_periods(spark, landing).count() == 6
    assert lake.list_periods(spark, f"{root}/nowhere").count() == 0


def test_damaged_periods_stop_no_other(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    rows = bronze(spark, *[{"fare_amount": float(n)} for n in range(2000)])
    for period in ("2024-01", "2024-02", "2024-03", "2024-04"):
        _land(rows, landing, period)
    # A sound footer over damaged pages, and a second file with a wrong type.
    (damaged,) = Path(f"{landing}/2024-02.parquet").glob("part-*.parquet")
    content = bytearray(damaged.read_bytes())
    content[4 : len(content) // 2] = b"\xff" * (len(content) // 2 - 4)
    damaged.write_bytes(content)
    for checksum in Path(f"{landing}/2024-02.parquet").glob(".*.crc"):
        checksum.unlink()
    wrong = rows.drop("period").withColumn("VendorID", F.col("VendorID").cast("bigint"))
    wrong.coalesce(1).write.mode("append").parquet(f"{landing}/2024-03.parquet")
    results = ingest_bronze(spark, landing, root)
    assert _statuses(results) == {
        "2024-01": ("OK", 2000),
        "2024-02": ("REJECTED", None),
        "2024-03": ("REJECTED", None),
        "2024-04": ("OK", 2000),
    }
    stored = lake.load_bronze(spark, root)
    assert dict(stored.groupBy("period").count().collect()) == {"2024-01": 2000, "2024-04": 2000}


def test_every_stage_is_logged(spark, small, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    write_landing(adapters.bronze(spark, small), landing)
    found = pipeline.run_all(spark, landing, root)
    log = runs.read_runs(spark, root)
    health = {row["job_type"]: row["succeeded"] for row in runlog.etl_health(log).collect()}
    assert health == {"ingest": 1, "silver": 1, "gold": 1, "features": 1, "train": 1}
    assert runlog.latest_silver_rows(log).first()[0] == lake.load_bronze(spark, root).count()
    assert runlog.months_ingested(log).first()[0] == found["ingest"].count()
    with pytest.raises(RuntimeError), pipeline.logged(spark, root, "gold"):
        raise RuntimeError("stopped")
    log = runs.read_runs(spark, root)
    assert [tuple(r) for r in log.where("status = 'failed'").select("job_type", "error").collect()] == [("gold", "stopped")]
    assert runs.clear_runs(spark, root) == 6 and runs.read_runs(spark, root).count() == 0


def test_silver_of_an_empty_lake(spark, tmp_path):
    assert pipeline.run_silver(spark, f"{tmp_path}/nothing").count() == 0


def test_publish_checks_the_grain_first(spark):
    name = "default.publish_check"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    good = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k int, v double")
    lake.publish_table(good, name, grain=["k"])
    lake.publish_table(good, name, grain=["k"])
    with pytest.raises(ValueError):
        lake.publish_table(good.union(good), name, grain=["k"])
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, 1.0), (2, None)]
    assert [t.name for t in spark.catalog.listTables("default") if t.name.startswith("publish_check")] == ["publish_check"]
    spark.sql(f"DROP TABLE {name}")


def test_ingest_rollup_edges(spark):
    def rollup(*rows):
        return ingest_rollup(spark.createDataFrame(list(rows), schemas.INGEST_RESULT)).first()

    assert tuple(rollup()) == ("succeeded", None, 0)
    ok = ("2024-01", "OK", None, 5, "p")
    bad = ("2024-02", "UNAVAILABLE", "gone", None, None)
    assert tuple(rollup(ok)) == ("succeeded", None, 5)
    assert tuple(rollup(bad)) == ("failed", "2024-02: UNAVAILABLE (gone)", None)
    assert tuple(rollup(bad, ok)) == ("partial", "2024-02: UNAVAILABLE (gone)", 5)


def test_pipeline_output_equals_direct_operators(spark, small, lake_root):
    trips = adapters.silver(spark, small)
    stored = lake.load_silver(spark, lake_root)
    assert stored.columns == trips.columns
    assert stored.exceptAll(trips).count() == 0 and trips.exceptAll(stored).count() == 0
    for name, build in gold.BUILDERS.items():
        assert lake.read_gold(spark, lake_root, name).collect() == build(trips).collect(), name
    quarantined = lake.load_quarantine(spark, lake_root)
    assert quarantined.count() == silver.quarantine_rows(adapters.bronze(spark, small)).count()
    assert set(quarantined.columns) == {*schemas.BRONZE_TABLE.names, "rule"}
    report = lake.read_quality_report(spark, lake_root)
    assert report.agg(F.sum("records_accepted")).first()[0] == stored.count()
    assert report.orderBy("period").collect() == silver.quality_report(adapters.bronze(spark, small)).orderBy("period").collect()


def test_report_files_are_one_json_object_per_period(lake_root):
    texts = [line for path in Path(lake_root).glob("quality_report/*.json") for line in path.read_text().splitlines()]
    reports = [json.loads(text) for text in texts]
    assert len({r["period"] for r in reports}) == len(reports) > 10
    assert set(reports[0]["missing_value_counts"]) == set(C.MONITORED_COLUMNS)


def test_online_snapshot(spark, lake_root):
    online = {row.key: json.loads(row.value) for row in spark.read.parquet(f"{lake_root}/online_features").collect()}
    features = lake.read_gold(spark, lake_root, C.FEATURE_TABLE)
    row = features.first()
    value = online[f"features:zone:{row.PULocationID}:hour:{row.pickup_hour}"]
    assert len(online) == features.count()
    assert value["trip_count"] == row.trip_count
    assert value["avg_fare"] == pytest.approx(row.avg_fare, abs=5e-5)
    assert list(value) == ["trip_count", "avg_fare", "avg_trip_distance", "avg_tip", "avg_passenger_count"]


def test_rerun_replaces_only_its_periods_and_clears_what_became_empty(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    _land(bronze(spark, {}, {"fare_amount": -1.0}), landing, "2024-01")
    _land(bronze(spark, {}, {}), landing, "2024-02")
    ingest_bronze(spark, landing, root)
    pipeline.run_silver(spark, root)
    assert lake.load_silver(spark, root).count() == 3
    _land(bronze(spark, {"total_amount": -1.0}), landing, "2024-01")
    ingest_bronze(spark, landing, root, ["2024-01"])
    report = {row.period: row for row in pipeline.run_silver(spark, root).collect()}
    assert (report["2024-01"].records_accepted, report["2024-02"].records_accepted) == (0, 2)
    assert dict(lake.load_silver(spark, root).groupBy("period").count().collect()) == {"2024-02": 2}
    assert [row.rule for row in lake.load_quarantine(spark, root).collect()] == [C.NEGATIVE_TOTAL_AMOUNTS]


def test_silver_and_quarantine_can_be_written_apart(spark, tmp_path):
    routed = silver.with_outcome(bronze(spark, {}, {"fare_amount": -1.0}, {"trip_distance": 200.0}))
    lake.write_quarantine(routed, f"{tmp_path}")
    assert lake.load_silver(spark, f"{tmp_path}").count() == 0
    lake.write_silver(routed, f"{tmp_path}")
    assert lake.load_silver(spark, f"{tmp_path}").count() == 1
    assert lake.load_quarantine(spark, f"{tmp_path}").count() == 2


def test_gold_files_and_missing_tables(spark, lake_root, tmp_path):
    for name in C.GOLD_TABLES:
        assert len(list(Path(lake_root).glob(f"gold/{name}/*.parquet"))) == 1
        empty = lake.read_gold(spark, f"{tmp_path}/none", name)
        assert empty.count() == 0 and empty.schema == schemas.GOLD[name]


def test_publish_replaces_the_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS published")
    first = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    lake.publish_table(first, "published.figures")
    assert [tuple(r) for r in spark.table("published.figures").orderBy("k").collect()] == [(1, None), (2, 2.0)]
    lake.publish_table(first.where("k = 2"), "published.figures")
    assert spark.table("published.figures").count() == 1


def test_first_failing_gold_table_stops_the_batch(spark, lake_root, monkeypatch):
    def fail(_):
        raise RuntimeError("broken")

    built = []
    monkeypatch.setattr(pipeline.lake, "write_gold", lambda table, root, name: built.append(name))
    monkeypatch.setitem(pipeline.BUILDERS, "hourly_demand", fail)
    with pytest.raises(RuntimeError):
        pipeline.run_gold(spark, lake_root, rollup=gold.trip_rollup(lake.load_silver(spark, lake_root)))
    assert built == ["daily_revenue"]


def test_inventory_and_storage(spark, lake_root, tmp_path):
    layers = lake.layers(lake_root)
    inventory = {row.layer: row for row in lake.lake_inventory(spark, layers).collect()}
    assert list(layers) == [
        "bronze", "silver", "silver-quarantine", "gold-daily-revenue", "gold-hourly-demand", "gold-zone-stats",
        "gold-congestion-metrics",
    ]
    assert set(inventory) == set(layers)
    on_disk = [p for p in Path(lake_root, "bronze").rglob("*.parquet")]
    assert inventory["bronze"].object_count == len(on_disk)
    objects = [row.path.removeprefix("file:") for row in lake.lake_objects(spark, {"bronze": layers["bronze"]}).collect()]
    assert sorted(objects) == sorted(map(str, on_disk))
    assert inventory["bronze"].total_bytes == sum(p.stat().st_size for p in on_disk)
    stats = {row.layer: row for row in lake.storage_stats(spark, layers).collect()}
    assert stats["silver"].total_rows == lake.load_silver(spark, lake_root).count()
    assert stats["silver-quarantine"].total_rows == lake.load_quarantine(spark, lake_root).count()
    assert stats["bronze"].bytes_per_row == round(stats["bronze"].total_bytes / stats["bronze"].total_rows, 2)
    nothing = lake.storage_stats(spark, {"none": [f"{tmp_path}/none"]}).first()
    assert tuple(nothing) == ("none", 0, 0, 0, None)
    assert tuple(lake.lake_inventory(spark, {"none": [f"{tmp_path}/none"]}).first()) == ("none", 0, 0, None, None)


def test_csv_export(spark, tmp_path):
    rows = [(1, 'say "hi", you', None, 0.1), (2, "two\nlines", "", 1234.5), (3, " padded ", "x", None), (4, "a\rb", None, None)]
    lake.export_csv(spark.createDataFrame(rows, "k int, a string, b string, c double").coalesce(1), f"{tmp_path}/csv")
    text = next(Path(f"{tmp_path}/csv").glob("*.csv")).read_bytes().decode()
    assert text == 'k,a,b,c\n1,"say ""hi"", you",,0.1\n2,"two\nlines",,1234.5\n3, padded ,x,\n4,"a\rb",,\n'


def test_reset(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    spark.sql("CREATE DATABASE IF NOT EXISTS resettable")
    _land(bronze(spark, {}), landing, "2024-01")
    _land(bronze(spark, {}), landing, "2024-02")
    ingest_bronze(spark, landing, root)
    pipeline.run_silver(spark, root)
    pipeline.run_gold(spark, root, "resettable")
    pipeline.run_features(spark, root, "resettable")
    removed = {(r.kind, r.name): r.removed for r in lake.reset_layers(spark, root, "resettable").collect()}
    assert removed[("folder", "bronze")] == 2
    assert removed[("online", "features")] == 1
    assert {name for kind, name in removed if kind == "table"} == {*C.GOLD_TABLES, C.FEATURE_TABLE}
    assert not any(files.exists(spark, f"{root}/{layer}") for layer in ("bronze", "silver", "gold"))
    again = {(r.kind, r.name): r.removed for r in lake.reset_layers(spark, root, "resettable").collect()}
    assert set(again.values()) == {0} and not any(kind == "table" for kind, _ in again)


def test_nan_becomes_null_on_read(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/lake"
    _land(bronze(spark, {"trip_distance": float("nan")}), landing, "2024-01")
    ingest_bronze(spark, landing, root)
    assert lake.load_bronze(spark, root).first().trip_distance is None
    assert set(BASE) == set(lake.load_bronze(spark, root).columns)


def test_silver_files_are_in_order_of_pickup(spark, lake_root):
    parts = sorted(Path(f"{lake_root}/silver").rglob("*.parquet"))
    folders = [tuple(folder.name for folder in part.parents)[:2] for part in parts]
    assert {outcome for _, outcome in folders} >= {f"outcome={C.ACCEPTED}"} and len(parts) > 5
    for part in parts:
        pickups = [at for at in pq.ParquetFile(part).read([C.PICKUP])[C.PICKUP].to_pylist() if at is not None]
        assert pickups == sorted(pickups)


def test_partitioned_write_sorts_once(spark, small, tmp_path):
    """The order of the files costs no sort beside the one that partitioned writes need."""
    seen = []
    listened = spark._jsparkSession.sharedState().statusStore()
    before = listened.executionsList().size()
    lake.write_routed(silver.with_outcome(adapters.bronze(spark, small)), str(tmp_path))
    for at in range(before, listened.executionsList().size()):
        text = listened.executionsList().apply(at).physicalPlanDescription()
        if "InsertIntoHadoopFsRelationCommand" in text:
            final = text.split("== Initial Plan ==")[0]
            seen.append(sum(1 for line in final.splitlines() if "- Sort" in line or "* Sort" in line))
    assert seen == [1]
