"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tripstrata import constants as C
from tripstrata.functions.quantiles import exact_percentiles
from tripstrata.operators import features, gold, silver
from tripstrata.sources import lake

def test_day_filter_reaches_the_scan(spark, lake_root):
    text = plan(silver.trips_of_day(lake.load_silver(spark, lake_root), "1996-01-02"))
    assert f"GreaterThanOrEqual({C.PICKUP},1996-01-02T00:00)" in text
    assert f"LessThan({C.PICKUP},1996-01-03T00:00)" in text


def test_silver_lists_the_accepted_folder_only(spark, lake_root):
    text = plan(lake.load_silver(spark, lake_root))
    assert f"[file:{lake.silver_path(lake_root)}/outcome={C.ACCEPTED}]" in text.replace("file://", "file:")


@pytest.mark.parametrize("name", list(gold.BUILDERS))
def test_gold_reads_only_its_columns(spark, lake_root, name):
    text = plan(gold.BUILDERS[name](lake.load_silver(spark, lake_root)))
    schema = text[text.index("ReadSchema: struct<") :]
    unused = {"VendorID", "RatecodeID", "store_and_fwd_flag", "tolls_amount", "Airport_fee", "extra"}
    assert not any(column in schema for column in unused)
    assert text.count("FileScan") == 1


def test_gold_from_the_rollup_does_not_scan_trips_again(spark, lake_root, tmp_path):
    path = f"{tmp_path}/rollup"
    gold.trip_rollup(lake.load_silver(spark, lake_root)).write.parquet(path)
    cells = spark.read.parquet(path)
    for build in (*gold.BUILDERS.values(), features.zone_hour_features):
        text = plan(build(cells))
        assert "silver" not in text and text.count("FileScan") == 1


def test_routing_is_narrow(spark, lake_root):
    text = plan(silver.with_outcome(lake.load_bronze(spark, lake_root)))
    assert "Exchange" not in text and text.count("FileScan") == 1


def test_percentiles_scan_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).write.parquet(f"{tmp_path}/v")
    df = exact_percentiles(spark.read.parquet(f"{tmp_path}/v"), "v", {"p50": 0.5}, ["k"])
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_stored_features_are_broadcast_by_their_size(spark, lake_root):
    requests = lake.load_silver(spark, lake_root).select(C.PICKUP_ZONE, F.hour(C.PICKUP).alias("pickup_hour"))
    table = lake.read_gold(spark, lake_root, C.FEATURE_TABLE)
    assert "BroadcastHashJoin" in plan(features.feature_lookup(requests, table))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        assert "SortMergeJoin" in plan(features.feature_lookup(requests, table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
