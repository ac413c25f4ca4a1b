from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import bronze
from tripstrata import constants as C
from tripstrata.operators import model, silver, trees
from tripstrata.plans import pipeline
from tripstrata.sources import lake


def test_sample_is_whole_or_exact(spark):
    df = spark.range(20_000)
    assert model.bounded_sample(df, 20_000).count() == 20_000
    sample = model.bounded_sample(df, 5_000)
    assert sample.count() == sample.distinct().count() == 5_000
    assert abs(sample.agg(F.avg("id")).first()[0] - 10_000) < 500


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(10_000)
    train, test = model.train_test_split(df)
    assert train.count() + test.count() == 10_000
    assert train.intersect(test).count() == 0
    assert 0.17 < test.count() / 10_000 < 0.23


def test_training_rows_are_complete(spark):
    gaps = [{name: None} for name in ("trip_distance", "PULocationID", "DOLocationID", "passenger_count", "fare_amount")]
    rows = model.training_rows(silver.silver_accepted(bronze(spark, {}, *gaps)))
    assert rows.count() == 1
    assert rows.columns == [*C.MODEL_FEATURES, C.MODEL_TARGET]


def test_metrics(spark):
    scored = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 3.0)], "fare_amount double, prediction double")
    row = model.regression_metrics(scored).first()
    assert row.mae == pytest.approx(4 / 3)
    assert row.rmse == pytest.approx((10 / 3) ** 0.5)
    assert row.r2 == pytest.approx(1 - 10 / 14)


def test_train_log_load_score(spark, lake_root):
    with pytest.raises(LookupError):
        model.latest_model(spark, f"{lake_root}/nothing")
    result = pipeline.run_training(spark, lake_root)
    assert result["rows"] == model.training_rows(lake.load_silver(spark, lake_root)).count()
    assert result["mae"] > 0 and result["rmse"] >= result["mae"]
    runs = spark.read.parquet(f"{lake_root}/model_runs")
    assert runs.where(F.col("run_id") == result["run_id"]).count() == 1

    trips = lake.load_silver(spark, lake_root)
    scored = model.score_fares(model.latest_model(spark, lake_root), trips, decimals=2)
    assert scored.count() == trips.count()
    assert scored.where("predicted_fare IS NULL").count() == 0
    assert scored.where("predicted_fare <> round(predicted_fare, 2)").count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).selectExpr("id * 0.5D AS a", "id % 7 AS b")
    for n in (1, 10, 700):
        one = sorted(map(tuple, model.bounded_sample(rows.repartition(3), n).collect()))
        two = sorted(map(tuple, model.bounded_sample(rows.repartition(11, "b"), n).collect()))
        assert one == two and len(one) == n
    train, test = model.train_test_split(rows.repartition(3))
    again, _ = model.train_test_split(rows.repartition(11, "b"))
    assert sorted(map(tuple, train.collect())) == sorted(map(tuple, again.collect()))
    assert train.count() + test.count() == 5000 and 850 < test.count() < 1150 and train.intersect(test).count() == 0


def test_forest_learns_a_known_fare(spark):
    noise = "(rand(3) - 0.5)"
    trips = spark.range(4000).selectExpr(
        "CAST(id % 50 AS DOUBLE) AS trip_distance",
        "CAST(id % 263 AS INT) AS PULocationID",
        "CAST(id % 101 AS INT) AS DOLocationID",
        "CAST(1 + id % 3 AS DOUBLE) AS passenger_count",
        "timestamp_ntz'2024-01-05 10:00:00' AS tpep_pickup_datetime",
        f"3 + 2.5D * (id % 50) + {noise} AS fare_amount",
    )
    _, quality = model.train_fare_model(trips)
    assert quality["r2"] > 0.8 and quality["rows"] == 4000


_WALK = """
WITH RECURSIVE nodes AS (SELECT * FROM read_parquet('{nodes}/*.parquet')),
step AS (
    SELECT t.id, n.* FROM trips t, nodes n WHERE n.node = 0
    UNION ALL
    SELECT t.id, n.* FROM step s JOIN trips t USING (id)
    JOIN nodes n ON n.tree = s.tree AND n.node = CASE WHEN coalesce(CASE s.feature
        WHEN 'trip_distance' THEN t.trip_distance WHEN 'PULocationID' THEN t."PULocationID"
        WHEN 'DOLocationID' THEN t."DOLocationID" WHEN 'passenger_count' THEN t.passenger_count
        WHEN 'pickup_hour' THEN t.pickup_hour END, 'nan'::DOUBLE) <= s.bound THEN s."left" ELSE s."right" END
    WHERE s.feature IS NOT NULL
)
SELECT id, avg(value) FROM step WHERE feature IS NULL GROUP BY id ORDER BY id"""


def test_another_engine_walks_the_stored_nodes(spark, lake_root):
    run_id = pipeline.run_training(spark, lake_root)["run_id"]
    assert model.latest_run(spark, lake_root)["run_id"] == run_id
    trips = model.with_pickup_hour(lake.load_silver(spark, lake_root)).select(*C.MODEL_FEATURES).distinct()
    numbered = trips.withColumn("id", F.monotonically_increasing_id())
    scored = model.score_fares(model.latest_model(spark, lake_root), numbered).orderBy("id").toPandas()
    duck = duckdb.connect()
    duck.register("trips", scored)
    walked = duck.sql(_WALK.format(nodes=model.nodes_path(lake_root, run_id))).fetchall()
    assert [row[0] for row in walked] == scored["id"].tolist() and len(walked) > 1000
    assert [row[1] for row in walked] == pytest.approx(scored["predicted_fare"].tolist(), abs=1e-9)


def _stump(spark, *more):
    rows = [(0, 0, "trip_distance", 2.0, 1, 2, 5.0, 9), (0, 1, None, None, None, None, 1.0, 4), (0, 2, *more)]
    schema = "tree int, node int, feature string, bound double, `left` int, `right` int, value double, rows bigint"
    return spark.createDataFrame(rows, schema)


def test_walk_edges(spark):
    stump = _stump(spark, None, None, None, None, 7.0, 5)
    shape = "trip_distance double, PULocationID int, DOLocationID int, passenger_count double, pickup_hour int, node string"
    at = [2.0, 2.1, None, float("nan"), 2.0]
    rows = spark.createDataFrame([(value, 1, None, 1.0, 3, "x") for value in at], shape)
    got = trees.walk(stump, rows, trees=1, depth=3).select(F.col("trip_distance").cast("string"), "rows", "prediction")
    assert set(map(tuple, got.collect())) == {("2.0", 2, 1.0), ("2.1", 1, 7.0), (None, 1, 7.0), ("NaN", 1, 7.0)}
    assert trees.walk(stump, rows.limit(0), trees=1, depth=3).count() == 0
    assert trees.walk(stump.limit(0), rows, trees=1, depth=3).count() == 0
    deeper = _stump(spark, "passenger_count", 1.0, 3, 4, 7.0, 5)
    with pytest.raises(Exception, match="deeper than 1"):
        trees.walk(deeper, rows, trees=1, depth=1).collect()


def test_hash_takes_values_beyond_a_long(spark):
    rows = spark.createDataFrame([(1e300,), (float("inf"),), (-2e11,), (None,), (0.5,)], "a double")
    train, test = model.train_test_split(rows)
    assert train.count() + test.count() == 5
