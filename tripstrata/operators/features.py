"""Zone-by-hour features, their key/JSON snapshot, and the lookup against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.fixed_point import mean
from .gold import trip_rollup

_MEANS = {
    "avg_fare": "fare",
    "avg_trip_distance": "distance",
    "avg_tip": "tip",
    "avg_passenger_count": "passengers",
}
_KEYS = [C.PICKUP_ZONE, "pickup_hour"]


def zone_hour_features(source: DataFrame) -> DataFrame:
    """Features per (pickup zone, hour) from Silver trips or a ``trip_rollup``."""
    cells = trip_rollup(source, *_KEYS)
    return cells.select(*_KEYS, "trip_count", *[mean(part).alias(name) for name, part in _MEANS.items()])


def publish_online(features: DataFrame) -> DataFrame:
    """Key and JSON value per feature row; means are rounded and missing ones written as null."""
    key = F.format_string(C.ONLINE_KEY_FORMAT, *_KEYS)
    value = F.struct("trip_count", *[F.round(name, C.ONLINE_DECIMALS).alias(name) for name in _MEANS])
    return features.select(key.alias("key"), F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def feature_lookup(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Requests with the features of their (zone, hour) and ``found``.

    No broadcast hint: a stored feature table is broadcast when its file size allows, a computed
    one when its shuffled size does; beyond that the join is a shuffle with skew handling.
    """
    marked = features.withColumn("found", F.lit(True))
    return requests.join(marked, _KEYS, "left").withColumn("found", F.coalesce("found", F.lit(False)))
