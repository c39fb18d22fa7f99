"""The table behind each chart: one row per mark, ready to draw.

Input is a count matrix or counts in long form, so these tables are as small as
the chart, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions.dates import month_label
from blotter.functions.names import column


def to_long(matrix: DataFrame, x: str, series: list[str] | None = None) -> DataFrame:
    """A matrix as rows ``(x, series_no, series, value)``; series keep their column order."""
    series = [c for c in matrix.columns if c != x] if series is None else list(series)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("series_no"), F.lit(s).alias("series"), column(s).cast("long").alias("value")
            )
            for i, s in enumerate(series)
        ]
    )
    return matrix.select(column(x).alias("x"), F.inline(cells))


def lines(matrix: DataFrame, x: str, series: list[str] | None = None) -> DataFrame:
    """Line chart: one point per cell, null where a pair does not occur."""
    return to_long(matrix, x, series).select("x", "series", "value")


def stacked_bars(matrix: DataFrame, x: str, series: list[str] | None = None) -> DataFrame:
    """Stacked bars: each segment runs from ``y0`` to ``y1``, in series order."""
    upto = (
        Window.partitionBy("x")
        .orderBy("series_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        to_long(matrix, x, series)
        .withColumn("y1", F.sum("value").over(upto))
        .select("x", "series", "value", (F.col("y1") - F.col("value")).alias("y0"), "y1")
    )


def outcome_bars(outcomes: DataFrame, key: str, labels: tuple[str, str] = ("Not Arrested", "Arrested")) -> DataFrame:
    """Stacked horizontal bars of two outcomes per key, with names for the outcomes."""
    no, yes = [c for c in outcomes.columns if c != key]
    named = outcomes.select(column(key), column(no).alias(labels[0]), column(yes).alias(labels[1]))
    return stacked_bars(named, key)


def month_lines(matrix: DataFrame, month: str = "month") -> DataFrame:
    """Line chart over the months, with tick labels."""
    points = lines(matrix, month)
    return points.select("x", month_label(F.col("x")).alias("label"), "series", "value")


def density_grid(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """A scatter plot as counts per grid cell; ``x0, y0`` is the lower corner of the cell."""
    cell = [
        F.floor(column(x) / width).cast("long").alias("cell_x"),
        F.floor(column(y) / height).cast("long").alias("cell_y"),
    ]
    counts = df.select(*cell).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "cell_x", "cell_y", (F.col("cell_x") * width).alias("x0"), (F.col("cell_y") * height).alias("y0"), "n"
    )


def confusion_heatmap(confusion: DataFrame, names: dict) -> DataFrame:
    """A confusion matrix with spoken names: row ``Arrested``, column ``Predicted Arrested``."""
    row = F.coalesce(*[F.when(F.col("label") == F.lit(v), F.lit(n)) for v, n in names.items()])
    return confusion.select(
        row.alias("true_label"),
        *[column(str(v)).alias(f"Predicted {n}") for v, n in names.items()],
    )


def roc_chart(curve: DataFrame, area: float) -> DataFrame:
    """A ROC curve with the chance line and the legend that states the area."""
    legend = f"ROC curve (area = {area:.2f})"
    return curve.select("fpr", "tpr", F.col("fpr").alias("diagonal"), F.lit(legend).alias("legend"))
