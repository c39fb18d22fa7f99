from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_percentage(share: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.round(share * 100, 2)


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
