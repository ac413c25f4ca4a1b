"""A fitted forest as a table of nodes, and the walk through it.

The table holds all that a prediction needs, so engines without Spark ML can score from it: a node
with ``feature`` sends a row left if the feature is at most ``bound``, else right (so does a missing
value, which is read as NaN and lies above every bound); one without is a leaf and gives ``value``. A
prediction is the mean of the leaves that a row ends in, summed in the order of the trees.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

if TYPE_CHECKING:
    import pandas as pd

_KEY = ("tree", "node")


def stored_nodes(spark: SparkSession, model_path: str, features: tuple[str, ...] = C.MODEL_FEATURES) -> DataFrame:
    """``(tree, node, feature, bound, left, right, value, rows)`` of a saved pipeline's forest, read where the
    model is stored; ``rows`` counts the training rows at the node. All features are numbers with an
    order, so every split has one bound. Node 0 is a tree's root; leaves have neither feature nor children.
    """
    saved = spark.read.parquet(f"{model_path}/stages/*/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    name = F.element_at(F.array(*map(F.lit, features)), F.col("split.featureIndex") + 1)
    return saved.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, name).alias("feature"),
        F.when(inner, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("bound"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
        F.col("rawCount").alias("rows"),
    )


def walk(
    nodes: DataFrame,
    rows: DataFrame,
    trees: int = C.MODEL_TREES,
    depth: int = C.MODEL_DEPTH,
    features: tuple[str, ...] = C.MODEL_FEATURES,
) -> DataFrame:
    """The features, ``rows`` (how many have them) and ``prediction`` for each different set of features.

    Equal rows walk once. Each task takes its sets down all trees at once, a level at a time; the nodes go
    with it, as their number follows trees and depth, not the rows. ``depth`` must be that of the deepest
    tree or more: a row that has not reached a leaf by then fails the query, it does not get an inner node's
    value. Without rows or without nodes there are none.
    """
    different = rows.groupBy(*(F.col(f"`{c}`") for c in features)).agg(F.count(F.lit(1)).alias("rows"))
    found = nodes.where(F.col("tree").between(0, trees - 1)).select(*_KEY, "feature", "bound", "left", "right", "value")
    descend = _descent(found.orderBy(*_KEY).toPandas(), depth, features)
    shape = T.StructType([*different.schema.fields, T.StructField("prediction", T.DoubleType())])
    # A shuffle of few sets must not end in one task; the other order of columns keeps this one from being
    # taken for the one before it.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = different.repartition(tasks, *(F.col(f"`{c}`") for c in reversed(features)))
    return spread.mapInArrow(descend, shape)


def _descent(table: pd.DataFrame, depth: int, features: tuple[str, ...]) -> Callable:
    """The function that adds ``prediction`` to batches; it holds the nodes, in order of tree and node, as arrays."""
    import numpy as np

    tree, node = table["tree"].to_numpy("int64"), table["node"].to_numpy("int64")
    span = int(node.max()) + 1 if len(node) else 1
    key, here = tree * span + node, np.arange(len(table))
    leaf = table["left"].isna().to_numpy()
    # A leaf leads to itself, so rows that have arrived stay while others go on.
    left, right = (
        np.where(leaf, here, np.searchsorted(key, tree * span + table[side].fillna(0).to_numpy("int64")))
        for side in ("left", "right")
    )
    place = table["feature"].map({name: at for at, name in enumerate(features)}).fillna(0).to_numpy("int64")
    bound, value = table["bound"].to_numpy("float64"), table["value"].to_numpy("float64")
    roots = here[node == 0]

    def descend(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(roots) or not batch.num_rows:
                continue
            columns = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(features))]
            given = np.column_stack(columns)
            at = np.repeat(roots[None, :], batch.num_rows, axis=0)
            for _ in range(depth):
                goes_left = np.take_along_axis(given, place[at], axis=1) <= bound[at]
                at = np.where(goes_left, left[at], right[at])
            if not leaf[at].all():
                raise ValueError(f"a tree is deeper than {depth}")
            total = np.zeros(batch.num_rows)
            for ended in at.T:
                total += value[ended]
            names = [*batch.schema.names, "prediction"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / len(roots))], names)

    return descend
