"""Top groups, frequency ranks and best rows. Ties are always broken by the value itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.operators.counts import group_sizes, value_counts
from blotter.operators.positions import with_position


def top_groups(
    df: DataFrame, keys: list[str], n: int = 15, size: str = "n", weight: str | None = None
) -> DataFrame:
    """The ``n`` largest groups, largest first."""
    sizes = group_sizes(df, keys, size, weight)
    return sizes.orderBy(F.desc(size), *[column(k) for k in keys]).limit(n)


def frequency_ranks(df: DataFrame, names: list[str], label: str = "ranks") -> DataFrame:
    """All values of the named columns with their rank in their column.

    Rank 0 is the most frequent value, equal counts are ranked by value. One pass
    over the table serves all columns, and no column is limited in its values.
    Returns ``(column, value, n, rank)``.
    """
    order = [F.col("column"), F.desc("n"), F.col("value")]
    return with_position(value_counts(df, names), order, "rank", label, group="column")


def best_row(results: DataFrame, metric: str, sequence: str) -> DataFrame:
    """The row with the highest metric; of equals, the one evaluated first."""
    return results.orderBy(F.desc(metric), column(sequence)).limit(1)


def mark_best(
    results: DataFrame, metric: str, sequence: str, mark: str = "bestModel", value: Column | float = 1000.0
) -> DataFrame:
    """Mark the best row of a result table with ``value`` and all others with 0.

    A result table has one row per parameter set, so one window over it is fine.
    """
    place = F.row_number().over(Window.orderBy(F.desc(metric), column(sequence)))
    other = F.lit(value) * 0
    return results.withColumn(mark, F.when(place == 1, F.lit(value)).otherwise(other))
