"""Delimited and Parquet tables.

Quotes inside a quoted value are doubled, and a value may run over several lines,
so what is written is what is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.names import column
from blotter.schema import INCIDENT_SCHEMA

_CSV = {"header": "true", "quote": '"', "escape": '"'}


def _source_of(spark: SparkSession, path: str | list[str]) -> str:
    """``parquet`` if the files end so, ``csv`` if none does. Tasks look at the names, whose content is not read."""
    # Partition folders such as Year=2020 are files' parents here, not columns.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kinds = files.select(F.col("path").endswith(".parquet").alias("parquet")).distinct().collect()
    if len(kinds) > 1:
        raise ValueError(f"Parquet and other files together in {path}: name the source")
    return "parquet" if kinds and kinds[0]["parquet"] else "csv"


def read_incidents(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = INCIDENT_SCHEMA,
    source: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Incident records under an explicit schema; nothing is inferred, so no pass over the data.

    ``source`` is ``csv`` or ``parquet``, by default told by the names of the files found there,
    which must be all of one kind.
    Parquet has types of its own, as ``clean --parquet`` writes them. In CSV, empty fields and
    numbers that cannot be read are null. ``multiline`` is for CSV with line breaks inside
    values; such files cannot be split between tasks.
    """
    if source is None:
        source = _source_of(spark, path)
    if source == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    return spark.read.options(**_CSV, multiLine=multiline, enforceSchema="true").csv(path, schema=schema)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    infer: bool = True,
    sampling: float = 1.0,
    multiline: bool = False,
) -> DataFrame:
    """A CSV table whose fields are named by its header; the key stays an ordinary column.

    Inferring the types reads the data once more. ``sampling`` below 1 infers from that share
    of the rows, which on large tables is enough to tell the types. Without ``infer`` every
    value is the text that stands in the file.
    """
    options = {"inferSchema": str(infer).lower(), "samplingRatio": str(sampling), "multiLine": multiline}
    return spark.read.options(**_CSV, **options).csv(path)


def as_csv_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text: CSV has no such types."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(column(f.name)).alias(f.name) if isinstance(f.dataType, nested) else column(f.name)
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a table as CSV with header, key column included, one file per partition."""
    as_csv_columns(df).write.mode(mode).options(**_CSV).csv(path)


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """Write a result table, which has few rows, as a single CSV file."""
    as_csv_columns(results).coalesce(1).write.mode(mode).options(**_CSV).csv(path)
