"""Values that could overload a join, found by a sketch of the rows themselves.

An index knows how often its values occurred where it was fitted; a value it has never met may
still stand in half of the rows it is applied to. ``approx_top_k`` keeps a bounded number of
candidates in each task and merges them, so one narrow pass finds every value above a share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A value in more than one of so many rows is heavy, so there are fewer of them.
HEAVY_SHARE = 1000
_TRACKED = 10 * HEAVY_SHARE


def heavy_values(rows: DataFrame, texts: dict[int, Column]) -> list[tuple[int, str]]:
    """(number, value) of the values that stand in more than one of ``HEAVY_SHARE`` rows of each text."""
    if not texts:
        return []
    named = rows.select(*[text.alias(f"t{no}") for no, text in texts.items()])
    tops = [F.expr(f"approx_top_k(t{no}, {HEAVY_SHARE}, {_TRACKED})").alias(f"t{no}") for no in texts]
    found = named.agg(F.count(F.lit(1)).alias("rows"), *tops).first()
    return [
        (no, top["item"])
        for no in texts
        for top in found[f"t{no}"] or []
        if top["item"] is not None and top["count"] * HEAVY_SHARE > found["rows"]
    ]


def spread(key: Column, settled: Column, row: Column) -> Column:
    """A join key for an outer join: rows that are settled get one of their own, which finds nothing and weighs on no task."""
    own = F.unhex(F.md5(F.concat(F.lit("settled row "), row.cast("string"))))
    return F.when(F.coalesce(settled, F.lit(False)) | key.isNull(), own).otherwise(key)
