"""Matrices of any number of categories, against the plain ones."""

import pytest
from pyspark.sql import functions as F

from blotter.operators import charts, counts, matrices
from blotter.plans.reports import write_reports
from blotter.sources import read_incidents, read_table

SCHEMA = "year int, `a type` string"


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(2019, "B"), (2019, "B"), (2020, "A"), (2020, None), (None, "A"), (2021, "C"), (2021, "E"), (2021, "D")]
    return spark.createDataFrame(data, SCHEMA)


def cells(blocks):
    return {(r.year, n): c for r in blocks.collect() for n, c in zip(r.names, r.counts, strict=True)}


def test_blocks_hold_the_matrix(pairs):
    plain = counts.crosstab(pairs, "year", "a type")
    expected = {(r.year, c): r[c] for r in plain.collect() for c in plain.columns[1:]}
    for width in (1, 2, 5, 1000):
        found = matrices.crosstab_blocks(pairs, "year", "a type", width)
        assert cells(found) == expected
        assert found.filter(F.size("names") > width).count() == 0
        assert found.count() == 3 * -(-5 // width)
    counted = counts.group_sizes(pairs, ["year", "a type"])
    assert cells(matrices.crosstab_blocks(counted, "year", "a type", 2, "n")) == expected


def test_written_blocks(spark, pairs, tmp_path):
    assert matrices.write_crosstab(pairs, "year", "a type", str(tmp_path / "m"), 2) == 3
    found = [read_table(spark, str(tmp_path / "m" / f"Block={i}")) for i in range(3)]
    assert [f.columns for f in found] == [["year", "A", "B"], ["year", "C", "D"], ["year", "E"]]
    assert [tuple(r) for r in found[0].orderBy("year").collect()] == [(2019, 0, 2), (2020, 1, 0), (2021, 0, 0)]


def test_nothing_to_count(spark, tmp_path):
    none = spark.createDataFrame([(None, "A"), (2019, None)], SCHEMA)
    assert matrices.crosstab_blocks(none, "year", "a type").count() == 0
    assert matrices.write_crosstab(none, "year", "a type", str(tmp_path / "m")) == 0
    assert matrices.stacked_counts(counts.group_sizes(none, ["year", "a type"]), "year", "a type").count() == 0


def test_stacked_counts_are_the_stacked_bars(pairs):
    plain = charts.stacked_bars(counts.crosstab(pairs, "year", "a type"), "year").filter("value > 0")
    found = matrices.stacked_counts(counts.group_sizes(pairs, ["year", "a type"]), "year", "a type")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_twenty_thousand_categories(spark):
    many = spark.range(60_000).selectExpr("cast(id % 3 as int) as year", "concat('c', id % 20000) as `a type`")
    found = matrices.crosstab_blocks(many, "year", "a type")
    assert len(found.columns) == 4 and found.count() == 60
    long = found.select("year", F.explode(F.arrays_zip("names", "counts")).alias("cell"))
    long = long.filter("cell.counts > 0").select("year", F.col("cell.names").alias("a type"), F.col("cell.counts").alias("n"))
    expected = counts.group_sizes(many, ["year", "a type"])
    assert long.exceptAll(expected).count() == expected.exceptAll(long).count() == 0


def test_wide_reports(spark, incident_csv, tmp_path):
    incidents = read_incidents(spark, incident_csv)
    assert sorted(write_reports(incidents, str(tmp_path / "plain"))) == sorted(write_reports(incidents, str(tmp_path / "wide"), True, 1))
    plain = read_table(spark, str(tmp_path / "plain" / "types_by_year"))
    blocks = sorted(p.name for p in (tmp_path / "wide" / "types_by_year").iterdir())
    assert len(blocks) == len(plain.columns) - 1
    first = read_table(spark, str(tmp_path / "wide" / "types_by_year" / "Block=0"))
    assert first.collect() == plain.select(*first.columns).collect()
    chart = read_table(spark, str(tmp_path / "wide" / "types_by_year_chart"))
    same = read_table(spark, str(tmp_path / "plain" / "types_by_year_chart")).filter("value > 0")
    assert sorted(map(tuple, chart.collect())) == sorted(map(tuple, same.collect()))
