"""Preparing the incident table: cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame

from blotter.operators.columns import drop_columns, to_canonical
from blotter.operators.filters import drop_incomplete
from blotter.operators.vocabulary import encode_columns, fit_vocabulary
from blotter.schema import NULL_TOKENS, RAW_ONLY_FIELDS
from blotter.sources.tables import write_table
from blotter.staging import stage

# Text columns that become word numbers, and what those are called.
ENCODED = {"Location Description": "Loc_Descr_Int", "Primary Type": "Prim_Type_Int"}


def clean(raw: DataFrame, null_tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Without the raw-only columns, and without rows that lack a value in the others."""
    return drop_incomplete(drop_columns(raw, RAW_ONLY_FIELDS), null_tokens)


def encode(cleaned: DataFrame, names: dict[str, str] = ENCODED) -> DataFrame:
    """The text columns replaced by word numbers from one shared vocabulary.

    The rows are read three times and staged, so that what made them is worked out once, and apart from the joins.
    """
    cleaned = stage(cleaned, "cleaned")
    vocabulary = fit_vocabulary(cleaned, list(names))
    return drop_columns(encode_columns(cleaned, names, vocabulary), list(names))


def write_canonical(cleaned: DataFrame, path: str) -> None:
    """The typed table as Parquet by year, so that reports on some years read those only.

    Rows are gathered by year to keep the files few; the rebalancing splits a year that is
    too large for one task over several.
    """
    to_canonical(cleaned).hint("rebalance", "Year").write.partitionBy("Year").parquet(path)


def write_clean(raw: DataFrame, path: str) -> None:
    write_table(clean(raw), path)


def write_encoded(raw: DataFrame, path: str) -> None:
    write_table(encode(clean(raw)), path)
