"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.names import column


def _has_value(field: T.StructField, null_tokens: list[str]) -> Column:
    value = column(field.name)
    present = value.isNotNull()
    if null_tokens and isinstance(field.dataType, T.StringType):
        present &= ~value.isin(list(null_tokens))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        present &= ~F.isnan(value)
    return present


def drop_incomplete(df: DataFrame, null_tokens: list[str] = ()) -> DataFrame:
    """Rows with a value in every column; text listed in ``null_tokens`` counts as none."""
    return df.filter(reduce(and_, [_has_value(f, null_tokens) for f in df.schema.fields]))


def filter_in(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Rows whose value is one of ``values``, exactly as written."""
    return df.filter(column(name).isin(list(values)))


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a value in every key: what the counting operators look at."""
    return df.filter(reduce(and_, [column(k).isNotNull() for k in keys]))
