"""Choosing, typing and unpacking columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.dates import occurred_at
from blotter.functions.names import column, index_name
from blotter.schema import CANONICAL_TYPES, INCIDENT_FIELDS


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[column(n) for n in names])


def rename_indexed(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns under their index names."""
    return df.select(*[column(n).alias(index_name(n)) for n in names])


def cast_columns(df: DataFrame, names: list[str], to: str = "double") -> DataFrame:
    """Cast the named columns; the others and the column order stay as they are.

    Text that is a truth value, such as ``TRUE``, becomes 1 or 0; other text that is no number
    is an error.
    """
    wanted = set(names)

    def number(field: T.StructField) -> Column:
        value = column(field.name)
        if isinstance(field.dataType, T.StringType):
            # Truth values first: a failing cast to a number costs an exception, and 0 and 1 are the same either way.
            return F.coalesce(value.try_cast("boolean").cast("int").cast(to), value.try_cast(to), value.cast(to))
        return value.cast(to)

    return df.select(*[number(f).alias(f.name) if f.name in wanted else column(f.name) for f in df.schema.fields])


def to_canonical(df: DataFrame) -> DataFrame:
    """The incident table with typed columns and ``occurred_at`` beside the date text.

    A value that does not fit its type becomes null.
    """
    typed = [
        column(c).try_cast(CANONICAL_TYPES[c]).alias(c) if c in CANONICAL_TYPES else column(c)
        for c in INCIDENT_FIELDS
    ]
    return df.select(*typed, occurred_at(F.col("Date")).alias("occurred_at"))


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def vector_elements(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Add the first elements of a vector column as columns of their own."""
    elements = vector_to_array(column(vector))
    return df.select("*", *[elements[i].alias(n) for i, n in enumerate(names)])


def peek(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*[column(c) for c in order]).limit(n)


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
