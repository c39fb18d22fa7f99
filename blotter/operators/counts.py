"""Counts and other aggregates. Each shuffles partial aggregates, never rows."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.dates import month_of
from blotter.functions.names import column
from blotter.functions.numbers import zero_if_null
from blotter.functions.text import tokenize
from blotter.operators.filters import drop_null_keys, filter_in
from blotter.staging import stage

def _tally(weight: str | None) -> Column:
    """The number of rows; of counted rows, the sum of their counts."""
    return F.count(F.lit(1)) if weight is None else F.sum(column(weight))


def category_values(df: DataFrame, name: str) -> list:
    """The distinct values of a column, sorted: they become columns of a matrix, so the driver must name them."""
    found = drop_null_keys(df, [name]).select(column(name).alias("value")).distinct().orderBy("value")
    return [r["value"] for r in found.collect()]


def group_sizes(
    df: DataFrame, keys: list[str], size: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per key combination, in long form; rows without a key do not count.

    Here and below, ``weight`` names a column of counts when ``df`` is counted already.
    """
    return (
        drop_null_keys(df, keys).groupBy(*[column(k) for k in keys]).agg(_tally(weight).alias(size))
    )


def trend(
    df: DataFrame, time: str, category: str, values: list | None = None, weight: str | None = None
) -> DataFrame:
    """Count matrix time x category; a pair that does not occur is null."""
    values = category_values(df, category) if values is None else list(values)
    return (
        drop_null_keys(df, [time, category])
        .select(
            column(time),
            column(category).alias("__category"),
            *([] if weight is None else [column(weight)]),
        )
        .groupBy(column(time))
        .pivot("__category", values)
        .agg(_tally(weight))
        .orderBy(column(time))
    )


def crosstab(
    df: DataFrame, row: str, category: str, values: list | None = None, weight: str | None = None
) -> DataFrame:
    """Count matrix row x category; a pair that does not occur is 0.

    Without ``values`` all categories that occur become columns, sorted by name. The pairs are
    counted first and staged then, so that finding the categories takes no second pass.
    """
    if values is None:
        df, weight = stage(group_sizes(df, [row, category], "__n", weight), "pairs"), "__n"
    matrix = trend(df, row, category, values, weight)
    return matrix.select(
        column(row), *[zero_if_null(column(c)).alias(c) for c in matrix.columns if c != row]
    )


def outcome_by(
    df: DataFrame,
    key: str,
    flag: str,
    names: tuple[str, str] = ("not_arrested", "arrested"),
    keys_in: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per key, how many rows have the flag unset and how many have it set."""
    if keys_in is not None:
        df = filter_in(df, key, keys_in)
    no, yes = names
    rows = F.lit(1) if weight is None else column(weight)
    return (
        drop_null_keys(df, [key, flag])
        .groupBy(column(key))
        .agg(
            F.sum(F.when(~column(flag), rows).otherwise(0)).alias(no),
            F.sum(F.when(column(flag), rows).otherwise(0)).alias(yes),
        )
        .orderBy(column(key))
    )


def seasonality(df: DataFrame, date_text: str, category: str, values: list | None = None) -> DataFrame:
    """Count matrix month x category; a pair that does not occur is null."""
    return trend(df.withColumn("month", month_of(column(date_text))), "month", category, values)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """How often each value of each named column occurs, as text, in one pass over the table."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("column"), column(n).cast("string").alias("value")) for n in names])
    )
    return (
        df.select(pairs.alias("pair"))
        .filter(F.col("pair.value").isNotNull())
        .groupBy(F.col("pair.column").alias("column"), F.col("pair.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each column, one row per column."""
    one_row = df.agg(
        *[F.avg(column(n)).alias(f"avg_{i}") for i, n in enumerate(names)],
        *[F.stddev_samp(column(n)).alias(f"std_{i}") for i, n in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.col(f"avg_{i}").alias("mean"), F.col(f"std_{i}").alias("std")
            )
            for i, n in enumerate(names)
        ]
    )
    return one_row.select(F.inline(rows))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Correlation of every two columns (each pair once), from one pass over the table."""
    pairs = list(combinations_with_replacement(names, 2))
    one_row = df.agg(*[F.corr(column(a), column(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one_row.select(F.inline(rows))


def token_counts(df: DataFrame, names: list[str], weight: str | None = None) -> DataFrame:
    """How often each token occurs in the named text columns together."""
    words = F.concat(*[F.coalesce(tokenize(column(n)), F.array().cast("array<string>")) for n in names])
    tallied = [] if weight is None else [column(weight)]
    return df.select(F.explode(words).alias("token"), *tallied).groupBy("token").agg(_tally(weight).alias("n"))


def mean_metric(df: DataFrame, params: list[str], metric: str, name: str = "avg_metric") -> DataFrame:
    """Mean over the folds of each parameter set."""
    return df.groupBy(*[column(p) for p in params]).agg(F.avg(column(metric)).alias(name))

