"""The walk of a forest costs no join for a level."""

from __future__ import annotations

from tests.helpers import plan
from tests.test_model import _stump
from tripstrata.operators import trees


def test_the_walk_has_no_join(spark):
    stump = _stump(spark, None, None, None, None, 7.0, 5)
    shape = "trip_distance double, PULocationID int, DOLocationID int, passenger_count double, pickup_hour int"
    rows = spark.createDataFrame([(2.0, 1, 1, 1.0, 3)], shape)
    walked = trees.walk(stump, rows, trees=1, depth=12)
    assert "Join" not in plan(walked) and walked.first()["prediction"] == 1.0
