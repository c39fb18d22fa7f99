"""One tree for all depths.

A tree of depth d is the deeper tree of the same rows, bins and leaf size cut at d: a node is split
by the rows that reach it alone, and where the cut falls the node's own majority answers. So one
fit and one scoring pass give the predictions at every depth: rows are counted by the leaf they
reach, and each leaf knows what the nodes on its path would have said.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.staging import fresh_path

_LEAF = "__leaf"


def tree_nodes(spark: SparkSession, model: DecisionTreeClassificationModel) -> dict[int, Row]:
    """The nodes by number, the root's is 0, from the saved model; they are as many as the driver holds in the model."""
    path = fresh_path(spark, "tree")
    model.write().save(path)
    kept = ("id", "prediction", "impurity", "leftChild", "rightChild", "split")
    return {n["id"]: n for n in spark.read.parquet(f"{path}/data").select(*kept).collect()}


def tree_leaves(nodes: dict[int, Row]) -> list[tuple[int, list[float], float]]:
    """For each leaf, from left to right, its node, what the nodes on its path say from the root down, and its impurity."""
    leaves: list[tuple[int, list[float], float]] = []
    waiting: list[tuple[int, list[float]]] = [(0, [])]
    while waiting:
        number, above = waiting.pop()
        node = nodes[number]
        said = [*above, node["prediction"]]
        if node["leftChild"] < 0:
            leaves.append((number, said, node["impurity"]))
        else:
            waiting += [(node["rightChild"], said), (node["leftChild"], said)]
    return leaves


def paths_to_leaves(
    spark: SparkSession, model: DecisionTreeClassificationModel, depths: list[int]
) -> list[tuple[float, list[float]]]:
    """For each leaf, by its number, the predictions of the tree cut at each of the depths."""
    leaves = tree_leaves(tree_nodes(spark, model))
    return [(float(at), [said[min(d, len(said) - 1)] for d in depths]) for at, (_, said, _) in enumerate(leaves)]


def counts_by_depth(
    model: DecisionTreeClassificationModel, rows: DataFrame, label: str, depths: list[int]
) -> DataFrame:
    """Rows per (depth, label, prediction) of the tree cut at each of the depths, from one pass over the rows."""
    reached = (
        model.copy({model.leafCol: _LEAF})
        .transform(rows)
        .groupBy(column(label).alias("label"), _LEAF)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    leaves = rows.sparkSession.createDataFrame(paths_to_leaves(rows.sparkSession, model, depths), f"{_LEAF} double, said array<double>")
    each = F.arrays_zip(F.array(*[F.lit(d).alias("d") for d in depths]).alias("depth"), F.col("said").alias("prediction"))
    return (
        reached.join(leaves, _LEAF)
        .select("label", "n", F.inline(each))
        .groupBy("depth", "label", "prediction")
        .agg(F.sum("n").alias("n"))
    )
