"""Evaluation of given predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.operators.positions import with_next, with_running_totals


def prediction_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction): all that the metrics below need, and as small as classes squared."""
    return (
        df.select(column(label).alias("label"), column(prediction).alias("prediction"))
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(counts: DataFrame) -> DataFrame:
    """Share of right predictions, in one row; null for no predictions."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.agg(F.try_divide(right.cast("double"), F.sum("n")).alias("accuracy"))


def class_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class: rows with it, rows predicted as it, hits and F1 (0 for a class never met).

    Counts of several results at once are told apart by the columns ``by``.
    """
    by = by or []
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("h")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
    )
    per_class = (
        counts.select(*[column(c) for c in by], F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    )
    f1 = 2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))
    return per_class.withColumn("f1", f1)


def weighted_f1(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the F1 of the classes, weighted by how often they occur, in one row, or in one for each value of ``by``."""
    scored = class_scores(counts, by)
    return scored.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1")
    )


def confusion_matrix(counts: DataFrame, labels: list) -> DataFrame:
    """Labels as rows, predictions as columns, 0 for what does not occur.

    Classes that occur and are not among ``labels`` follow those, so no row is left out but
    those without a label or prediction.
    """
    met = counts.select(F.explode(F.array("label", "prediction")).alias("class")).filter("class is not null").distinct()
    labels = [*labels, *sorted(r["class"] for r in met.collect() if r["class"] not in set(labels))]
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == F.lit(v), F.col("n"))), F.lit(0)).alias(str(v))
        for v in labels
    ]
    found = counts.filter(F.col("label").isin(list(labels))).groupBy("label").agg(*cells)
    # A class without rows still is a row of the matrix.
    every = counts.sparkSession.createDataFrame([(v,) for v in labels], found.select("label").schema)
    return (
        every.join(found, "label", "left")
        .select("label", *[F.coalesce(column(str(v)), F.lit(0)).alias(str(v)) for v in labels])
        .orderBy("label")
    )


def score_counts(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Positive and negative rows per distinct score; every label other than ``positive`` is negative.

    A boolean label is 1 or 0. Rows without label or score do not count.
    """
    kind = df.schema[label].dataType.simpleString()
    hit = ((column(label).cast("int") if kind == "boolean" else column(label)) == F.lit(positive)).cast("int")
    return (
        df.filter(column(label).isNotNull() & column(score).isNotNull())
        .groupBy(column(score).alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )


def ranked_scores(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Per distinct score, highest first: positives and negatives at or above it, staged for curve and area."""
    return with_running_totals(
        score_counts(df, label, score, positive),
        [F.desc("score")],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        "scores",
    )


def curve(ranked: DataFrame) -> DataFrame:
    """The ROC curve: one point per distinct score, and the start (0, 0) without a threshold.

    Rates are null where one of the two classes has no rows.
    """
    all_pos, all_neg = ranked.agg(F.max("tp"), F.max("fp")).first()
    start = ranked.sparkSession.createDataFrame([(0, 0, None)], "fp long, tp long, threshold double")
    points = start.unionByName(ranked.select("fp", "tp", F.col("score").alias("threshold")))
    return points.select(
        F.try_divide(F.col("fp").cast("double"), F.lit(all_neg)).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(all_pos)).alias("tpr"),
        "threshold",
    )


def corners(ranked: DataFrame) -> DataFrame:
    """The ranked scores without those at which the curve goes on as it came: same step of both counts as the next.

    The first and the last stay, so the area under the points that are left is the same.
    """
    steps = with_next(ranked, [F.desc("score")], ["pos", "neg"], "corners")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return steps.filter(first | F.col("next_pos").isNull() | turns).drop("next_pos", "next_neg")


def area(ranked: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, in one row; null where a class has no rows."""
    # Sums of products of two row counts outgrow 64 bits, hence doubles.
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    whole = F.max("tp").cast("double") * F.max("fp").cast("double")
    return ranked.agg(F.try_divide(F.sum(strip), whole).alias("auc"))


def roc_points(
    df: DataFrame, label: str = "label", score: str = "score", positive=1, drop_collinear: bool = False
) -> DataFrame:
    """The curve at all scores, or with ``drop_collinear`` at those where it turns."""
    ranked = ranked_scores(df, label, score, positive)
    return curve(corners(ranked) if drop_collinear else ranked)


def roc_area(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    return area(ranked_scores(df, label, score, positive))
