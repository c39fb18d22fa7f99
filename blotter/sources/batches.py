"""Export of a table in batches of a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.operators.positions import with_position, with_source_position
from blotter.sources.tables import as_csv_columns, read_table


def with_batches(
    df: DataFrame, keys: list[str | Column] | None, size: int = 30_000, name: str = "Batch"
) -> DataFrame:
    """Add the 1-based batch number of each row: ``size`` rows per batch, the last may be short.

    Without ``keys`` rows stand as in the files they are read from, the files by name; nothing
    is sorted then. With keys they stand in key order. Rows with equal keys are ordered by their content and full copies by where they stand in
    the input, so a key that fills much of the table is still spread over many tasks. The input
    should be a table read from files: those come in the same order when a task is repeated.
    """
    if not keys:
        return _cut(with_source_position(df, "__position", "batches"), size, name)
    content, place = "__content", "__place"
    told_apart = df.withColumns(
        {content: F.xxhash64(*[column(c) for c in df.columns]), place: F.monotonically_increasing_id()}
    )
    order = [column(k) if isinstance(k, str) else k for k in keys]
    placed = with_position(
        told_apart, [*order, F.col(content), F.col(place)], "__position", "batches"
    ).drop(content, place)
    return _cut(placed, size, name)


def _cut(placed: DataFrame, size: int, name: str) -> DataFrame:
    return placed.withColumn(name, F.floor(F.col("__position") / size).cast("long") + 1)


def export_batches(
    spark: SparkSession,
    src: str | DataFrame,
    dst: str,
    keys: list[str] | None = None,
    size: int = 30_000,
    index: bool = False,
    flat: bool = False,
) -> None:
    """Cut a table into folders ``Batch=1`` .. ``Batch=n`` below ``dst``, one CSV file with header in each.

    Read back as a table, the folders' number is a column. With ``flat`` the files are named
    ``Batch_1.csv`` .. ``Batch_n.csv`` instead and the folders go.

    Without ``keys`` rows keep the order of their source. A file is taken over as the text it is,
    with keys ordered by number where they are numbers. With
    ``index`` the 0-based position of each row is written as first column.
    """
    if isinstance(src, str):
        df = read_table(spark, src, infer=False)
        order = [c for k in keys or [] for c in (column(k).try_cast("double"), column(k))]
    else:
        df, order = src, list(keys or [])
    batched = with_batches(as_csv_columns(df), order, size)
    data = [column(c) for c in df.columns]
    if index:
        data = [F.col("__position").alias("index"), *data]
    (
        # By range: rows stand in this order already, so most of them stay among their neighbours.
        batched.repartitionByRange("Batch")
        .sortWithinPartitions("Batch", "__position")
        .select("Batch", *data)
        .write.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .partitionBy("Batch")
        .csv(dst)
    )
    if flat:
        name_batch_files(spark, dst)


def name_batch_files(spark: SparkSession, dst: str) -> None:
    """``Batch=<n>/part-*`` becomes ``Batch_<n>.csv``: a rename for each batch, whose data stay where they are."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(dst)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in store.listStatus(root):
        kind, _, number = folder.getPath().getName().partition("=")
        if folder.isDirectory() and kind == "Batch":
            parts = [f.getPath() for f in store.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) == 1 and store.rename(parts[0], jvm.org.apache.hadoop.fs.Path(root, f"Batch_{number}.csv")):
                store.delete(folder.getPath(), True)
