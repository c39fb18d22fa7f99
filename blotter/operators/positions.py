"""Positions and running totals over a whole table, without a one-task window.

The table is range-partitioned by the wanted order and staged. Each partition
then is a *block*: a contiguous run of the order whose totals are one row. The
running totals of the blocks are small (one row per partition) and are what the
rows of a block start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.staging import stage

# monotonically_increasing_id() is documented as partition number * 2^33 + row number.
_ROW_BITS = 33
_BLOCK, _ROW = "__block", "__row"


def in_blocks(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` staged in blocks of ``order``, with block number and row number in the block."""
    slot = "__slot"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(ordered.withColumn(slot, F.monotonically_increasing_id()), label)
    return (
        staged.withColumn(_BLOCK, F.shiftright(slot, _ROW_BITS))
        .withColumn(_ROW, F.col(slot).bitwiseAND((1 << _ROW_BITS) - 1))
        .drop(slot)
    )


def _fetched(rows: DataFrame) -> DataFrame:
    """A result of a row or so per partition, fetched once and broadcast by whoever uses it."""
    return F.broadcast(rows.sparkSession.createDataFrame(rows.collect(), rows.schema))


def _before(value: str, group: list[str]) -> Column:
    """The sum of ``value`` over the blocks before this one."""
    earlier = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def with_position(
    df: DataFrame,
    order: list[Column],
    position: str = "position",
    label: str = "position",
    group: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the given order.

    With ``group`` positions start at 0 in each group; ``order`` must begin with that column,
    and there must be few groups, such as one per column of a table. ``order`` should be a
    total order; where it is not, tied rows get the positions of their run in some order.
    """
    blocks = in_blocks(df, order, label)
    groups = [] if group is None else [group]
    starts = blocks.groupBy(_BLOCK, *groups).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_ROW).alias("__first")
    )
    offset = _fetched(starts.select(_BLOCK, *groups, (_before("__rows", groups) - F.col("__first")).alias("__offset")))
    return (
        blocks.join(offset, [_BLOCK, *groups])
        .withColumn(position, F.col("__offset") + F.col(_ROW))
        .select(*[column(c) for c in df.columns], position)
    )


def with_source_position(df: DataFrame, position: str = "position", label: str = "source") -> DataFrame:
    """Add the 0-based position of each row in the files ``df`` is read from: by file name, then as they stand in it.

    Nothing is sorted or exchanged. A block is what one task reads of one file, whose rows come in
    order; what precedes it is known from the blocks' row counts, one number for each.
    """
    if "_metadata" in df.columns:
        raise ValueError("the column _metadata hides where the rows are read from")
    file, start, number = "__file", "__start", "__number"
    read = df.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(start),
        F.monotonically_increasing_id().alias(number),
    )
    # Written once, so that counting and numbering see the same rows in the same blocks.
    staged = stage(read, label)
    blocks = staged.groupBy(file, start).agg(F.count(F.lit(1)).alias("__rows"), F.min(number).alias("__first"))
    earlier = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0))
    offset = _fetched(blocks.select(file, start, (before - F.col("__first")).alias("__offset")))
    return (
        staged.join(offset, [file, start])
        .withColumn(position, F.col("__offset") + F.col(number))
        .select(*[column(c) for c in df.columns], position)
    )


def with_next(df: DataFrame, order: list[Column], names: list[str], label: str = "next") -> DataFrame:
    """Add ``next_<name>`` of the named columns: their values in the row that follows, null after the last row.

    Only the first row of each block is exchanged, with the block before it.
    """
    blocks = in_blocks(df, order, label)
    one_on = Window.orderBy(_BLOCK)
    firsts = blocks.filter(F.col(_ROW) == 0).select(
        F.lag(_BLOCK).over(one_on).alias(_BLOCK), *[column(c).alias(f"__after_{c}") for c in names]
    )
    after = _fetched(firsts.filter(F.col(_BLOCK).isNotNull()))
    within = Window.partitionBy(_BLOCK).orderBy(_ROW)
    last = "__last"
    led = blocks.select(
        "*", F.lead(_ROW).over(within).isNull().alias(last), *[F.lead(column(c)).over(within).alias(f"__lead_{c}") for c in names]
    )
    following = [F.when(F.col(last), column(f"__after_{c}")).otherwise(column(f"__lead_{c}")).alias(f"next_{c}") for c in names]
    return led.join(after, _BLOCK, "left").select(*[column(c) for c in df.columns], *following)


def with_running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, Column], label: str = "running"
) -> DataFrame:
    """Add, for each ``name: value``, the sum of ``value`` over the rows up to and including this one."""
    blocks = in_blocks(df, order, label)
    totals = blocks.groupBy(_BLOCK).agg(*[F.sum(value).alias(f"__{name}") for name, value in sums.items()])
    starts = _fetched(totals.select(_BLOCK, *[_before(f"__{n}", []).alias(f"__start_{n}") for n in sums]))
    within = (
        Window.partitionBy(_BLOCK)
        .orderBy(_ROW)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = blocks.select(
        "*", *[F.sum(value).over(within).alias(f"__sum_{name}") for name, value in sums.items()]
    )
    return running.join(starts, _BLOCK).select(
        *[column(c) for c in df.columns],
        *[(F.col(f"__start_{n}") + F.col(f"__sum_{n}")).alias(n) for n in sums],
    )
