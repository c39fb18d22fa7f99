"""Train/test splits and folds that depend on the row's key alone.

A row falls on the same side whatever the partitioning, the run or the engine,
and all rows with the same key fall on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column


def key_bucket(keys: list[str], seed: int, buckets: int, purpose: str | None = None) -> Column:
    """A bucket number from 0 to ``buckets - 1``, even over distinct keys.

    Buckets of different purposes are independent of each other, also under one seed.
    """
    prefix = str(seed) if purpose is None else f"{purpose}:{seed}"
    text = F.concat_ws(":", F.lit(prefix), *[column(k).cast("string") for k in keys])
    prefix = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return (prefix % buckets).cast("int")


def with_split(
    df: DataFrame, keys: list[str], test_percent: int = 25, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Add a flag that is true for the test rows."""
    return df.withColumn(name, key_bucket(keys, seed, 100) < test_percent)


def train_test_split(
    df: DataFrame, keys: list[str], test_percent: int = 25, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The training rows and the test rows."""
    is_test = key_bucket(keys, seed, 100) < test_percent
    return df.filter(~is_test), df.filter(is_test)


def with_folds(df: DataFrame, keys: list[str], folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add a fold number from 0 to ``folds - 1``."""
    return df.withColumn(name, key_bucket(keys, seed, folds, "fold"))
