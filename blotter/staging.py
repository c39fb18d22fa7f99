"""Intermediate tables in the cluster's shared checkpoint folder.

Some operators read one intermediate result twice and need both reads to see the
same rows in the same partitions (a range partitioning is sampled anew by every
query). They write it once as Parquet and go on from the files: the lineage ends
there, a lost executor costs a re-read, and the second read is pruned to the
columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from blotter.functions.names import column

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: str | None = None
_released = 0


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; on a
    cluster that folder would not be shared, so there it is an error.
    """
    global _own_folder
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="blotter-")
    return _own_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the staging root, grouped by application so it can be cleared by it."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written out as Parquet, in folders by one column if given, and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path).select(*[column(c) for c in df.columns])


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled is deleted when that query ends, not when the driver happens to collect garbage.

    For plans of many staged steps, whose old shuffles no one reads again; a query that is run twice shuffles twice.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def tenure(spark: SparkSession) -> tuple[str, str, int]:
    """What staged tables belong to: they can be used again as long as this stays the same."""
    return spark.sparkContext.applicationId, staging_root(spark), _released


def release(spark: SparkSession) -> None:
    """Delete what the application has staged; DataFrames that read it cannot be used any more."""
    global _released
    _released += 1
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
