"""Count matrices of any number of categories, in blocks of columns.

The categories are a numbered table, not a list: what the driver or a row holds is one block of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.operators.counts import group_sizes
from blotter.operators.positions import with_position, with_running_totals
from blotter.sources.tables import write_table
from blotter.staging import stage

WIDTH = 1000


def numbered_categories(pairs: DataFrame, category: str, width: int = WIDTH) -> DataFrame:
    """``(name, block, place)``: the categories in order, ``width`` to a block, with their place in it."""
    names = pairs.select(column(category).alias("name")).distinct()
    numbered = with_position(names, [F.col("name")], "no", "categories")
    return stage(
        numbered.select(
            "name",
            F.floor(F.col("no") / width).cast("int").alias("block"),
            (F.col("no") % width).cast("int").alias("place"),
        ),
        "categories",
    )


def _parts(df: DataFrame, row: str, category: str, width: int, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """The counted pairs and the numbered categories."""
    pairs = stage(group_sizes(df, [row, category], "__n", weight), "pairs")
    return pairs, numbered_categories(pairs, category, width)


def _cells(pairs: DataFrame, names: DataFrame, row: str, category: str) -> DataFrame:
    """One row for each row key and block that meet: ``(row, block, found)``, found by place."""
    keyed = pairs.select(column(row).alias("row"), column(category).alias("name"), F.col("__n").alias("n"))
    found = F.map_from_entries(F.collect_list(F.struct("place", "n")))
    return keyed.join(names, "name").groupBy("row", "block").agg(found.alias("found"))


def crosstab_blocks(
    df: DataFrame, row: str, category: str, width: int = WIDTH, weight: str | None = None
) -> DataFrame:
    """Count matrix row x category as ``(row, block, names, counts)``: ``width`` categories and their counts.

    Every row key has every block; a pair that does not occur counts 0, rows without a key do not
    count. No value of the data becomes a column, so neither the plan nor the driver grows with
    the categories.
    """
    pairs, names = _parts(df, row, category, width, weight)
    heads = names.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("head"))
    number = F.max("block").alias("last")
    keys = pairs.select(column(row).alias("row")).distinct()
    # One number, so a broadcast of a row; every key then has all blocks.
    grid = keys.join(F.broadcast(names.agg(number))).select("row", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    cells = _cells(pairs, names, row, category)
    filled = grid.join(cells, ["row", "block"], "left").join(heads, "block")
    count = F.transform("head", lambda h: F.coalesce(F.element_at("found", h["place"]), F.lit(0).cast("long")))
    return filled.select(
        F.col("row").alias(row), "block", F.transform("head", lambda h: h["name"]).alias("names"), count.alias("counts")
    )


def write_crosstab(
    df: DataFrame, row: str, category: str, path: str, width: int = WIDTH, weight: str | None = None
) -> int:
    """Write the matrix as CSV tables ``Block=0``, ``Block=1``, … of ``width`` categories each; returns how many.

    Each has the row key and its own categories as columns, in the order of their names. The
    driver names the columns of one block at a time; the counted pairs are read, never the rows.
    Names that differ in case only need ``spark.sql.caseSensitive``, as for any table.
    """
    pairs, names = _parts(df, row, category, width, weight)
    keys = stage(pairs.select(column(row).alias("row")).distinct(), "keys")
    # In folders by block, so that each table reads its own cells.
    cells = stage(_cells(pairs, names, row, category), "cells", by="block")
    last = names.agg(F.max("block").alias("last")).first()["last"]
    blocks = 0 if last is None else last + 1
    for block in range(blocks):
        heads = names.filter(F.col("block") == block).orderBy("place").select("name").collect()
        own = cells.filter(F.col("block") == block).select("row", "found")
        columns = [
            F.coalesce(F.element_at("found", F.lit(i)), F.lit(0).cast("long")).alias(str(h["name"]))
            for i, h in enumerate(heads)
        ]
        table = keys.join(own, "row", "left").orderBy("row").select(F.col("row").alias(row), *columns)
        write_table(table, f"{path}/Block={block}")
    return blocks


def stacked_counts(counts: DataFrame, x: str, series: str, n: str = "n") -> DataFrame:
    """Stacked bars from counts in long form: ``(x, series, value, y0, y1)``, series in the order of their names.

    Only pairs that occur have a segment. Running totals go over the whole table and are taken
    relative to where their bar begins, so a bar of very many segments is no task of its own.
    """
    marks = counts.select(column(x).alias("x"), column(series).alias("series"), column(n).cast("long").alias("value"))
    marks = marks.filter(F.col("x").isNotNull() & F.col("series").isNotNull())
    running = stage(
        with_running_totals(marks, [F.col("x"), F.col("series")], {"upto": F.col("value")}, "stacks"), "stacked"
    )
    begins = running.groupBy("x").agg(F.min(F.col("upto") - F.col("value")).alias("begin"))
    return running.join(begins, "x").select(
        "x",
        "series",
        "value",
        (F.col("upto") - F.col("value") - F.col("begin")).alias("y0"),
        (F.col("upto") - F.col("begin")).alias("y1"),
    )
