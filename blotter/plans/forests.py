"""What a forest says of a batch of rows at once.

Spark's forest walks row by row from node object to node object, which takes most of the time of a job
whose forest has a hundred deep trees. Here all nodes are arrays that are sent to the tasks, and a batch
of rows goes down a tree level by level. Splits, shares of votes and their order of addition are the
model's own, so predictions and scores are the same numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.staging import fresh_path

# The functions that run in Python workers are sent along with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Node values (nodes times classes) of a forest that every Python worker may hold; a larger one is left to Spark.
NODE_VALUES = 16_000_000


def forest_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> dict[str, np.ndarray] | None:
    """Per node, all trees in one: feature, threshold, both next nodes and shares of the classes; None if a split is by category.

    The next node of a leaf is the leaf itself. ``roots`` has the first node of every tree, ``levels`` its depth.
    """
    path = fresh_path(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    saved = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), node["split"]["leftCategoriesOrThreshold"].alias("at"),
        node["split"]["numCategories"].alias("categories"), node["impurityStats"].alias("stats"),
    ).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, number, left, right, feature, categories = (
        saved[c].to_numpy() for c in ("treeID", "id", "left", "right", "feature", "categories")
    )
    inner = left >= 0
    if (categories[inner] != -1).any():
        return None
    _, roots, sizes = np.unique(tree, return_index=True, return_counts=True)
    own = np.arange(len(tree))
    start = np.repeat(roots, sizes)
    following = np.where(inner[:, None], np.stack([left, right], axis=1) + start[:, None], own[:, None])
    threshold = np.full(len(tree), np.inf)
    threshold[inner] = saved["at"].filter(pa.array(inner)).combine_chunks().flatten().to_numpy()
    counts = saved["stats"].combine_chunks().flatten().to_numpy().reshape(len(tree), model.numClasses)
    total = counts.sum(axis=1, keepdims=True)
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)
    return {
        "feature": np.where(inner, feature, 0), "threshold": threshold, "following": following.ravel(),
        "shares": shares, "roots": roots, "levels": np.array([t.depth for t in model.trees]),
    }


def voted(rows: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """The votes for every class, row by row."""
    n, width = rows.shape
    values, first = rows.ravel(), np.arange(n) * width
    votes = np.zeros((n, forest["shares"].shape[1]))
    for root, levels in zip(forest["roots"].tolist(), forest["levels"].tolist()):
        node = np.full(n, root)
        for _ in range(levels):
            right = ~(values.take(first + forest["feature"].take(node)) <= forest["threshold"].take(node))
            node = forest["following"].take(2 * node + right)
        votes += forest["shares"].take(node, axis=0)
    return votes


def _scorer(sent) -> Callable[[pa.Array], pa.Array]:
    def score(features: pa.Array) -> pa.Array:
        n = len(features)
        if not n:
            return pa.StructArray.from_arrays([pa.array([], pa.float64())] * 2, ["prediction", "score"])
        votes = voted(features.flatten().to_numpy().reshape(n, -1), sent.value)
        total = sum(votes.T)
        second = votes[:, 1] if votes.shape[1] > 1 else np.zeros(n)
        shares = np.divide(second, total, out=np.zeros(n), where=total != 0)
        return pa.StructArray.from_arrays([pa.array(votes.argmax(axis=1).astype(float)), pa.array(shares)], ["prediction", "score"])

    return score


def with_votes(model: RandomForestClassificationModel, rows: DataFrame, features: str, most: int = NODE_VALUES) -> DataFrame:
    """``rows`` with ``prediction`` and ``score``, the share of votes for the second class."""
    spark = rows.sparkSession
    small = model.totalNumNodes * model.numClasses <= most
    nodes = forest_nodes(spark, model) if small else None
    if nodes is None:
        score = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
        return model.transform(rows).withColumn("score", score)
    udf = F.arrow_udf(_scorer(spark.sparkContext.broadcast(nodes)), "prediction double, score double")
    said: Column = udf(vector_to_array(column(features)))
    return rows.withColumn("__said", said).select(*[column(c) for c in rows.columns], "__said.prediction", "__said.score")
