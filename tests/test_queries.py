"""The registered queries: a few of them against their SQL; ``check_oracle.py`` runs all."""

import os

import pytest
from check_oracle import compare, connect

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables here")


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 80


@needs_tables
def test_entry(spark):
    assert entry(spark).columns[0] == "year" and entry(spark).count() == 7


@needs_tables
@pytest.mark.parametrize(
    "name", ["s5_export_batches", "a3_trend", "c4_outcome_bars", "k2_frequency_ranks", "x4_standardize", "e4_roc_points"]
)
def test_query_agrees_with_sql(spark, name):
    found = compare(spark, connect(SMOKE_DIR), SMOKE_DIR, queries()[name], oracle_sql()[name])
    assert found == ""
