import pytest
from pyspark.sql import functions as F

from blotter.operators import charts, counts, ranking
from blotter.plans.reports import incident_reports, write_reports
from blotter.sources import read_incidents


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(2019, "A"), (2019, "A"), (2020, "B"), (2020, None), (None, "A"), (2021, "C")]
    return spark.createDataFrame(data, "year int, type string")


def test_crosstab_fills_and_drops_null_keys(pairs):
    found = counts.crosstab(pairs, "year", "type")
    assert found.columns == ["year", "A", "B", "C"]
    assert rows(found) == [(2019, 2, 0, 0), (2020, 0, 1, 0), (2021, 0, 0, 1)]


def test_named_crosstab_keeps_rows_without_named_categories(pairs):
    assert rows(counts.crosstab(pairs, "year", "type", ["B", "X"])) == [(2019, 0, 0), (2020, 1, 0), (2021, 0, 0)]


def test_trend_leaves_gaps(pairs):
    assert rows(counts.trend(pairs, "year", "type", ["B", "X"])) == [(2019, None, None), (2020, 1, None), (2021, None, None)]


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([("a.b", "x (y.z)")], "`row key` string, `col.name` string")
    assert rows(counts.crosstab(df, "row key", "col.name")) == [("a.b", 1)]


def test_weighted_counts_equal_plain_counts(pairs):
    counted = counts.group_sizes(pairs, ["year", "type"])
    assert rows(counts.crosstab(counted, "year", "type", weight="n")) == rows(counts.crosstab(pairs, "year", "type"))


def test_any_number_of_categories(spark):
    many = spark.range(1200).selectExpr("id", "2020 as year", "concat('c', id) as type")
    assert len(counts.category_values(many, "type")) == 1200
    assert len(counts.crosstab(many, "year", "type").columns) == 1201


def test_outcomes(spark):
    data = [("x", True), ("x", False), ("x", False), ("y", True), ("z", None), (None, True)]
    df = spark.createDataFrame(data, "place string, flag boolean")
    assert rows(counts.outcome_by(df, "place", "flag")) == [("x", 2, 1), ("y", 0, 1)]
    assert rows(counts.outcome_by(df, "place", "flag", keys_in=["y", "Y"])) == [("y", 0, 1)]


def test_stacked_bars(spark):
    matrix = spark.createDataFrame([(2019, 2, 0, 3)], "year int, b long, a long, c long")
    found = {r.series: (r.x, r.value, r.y0, r.y1) for r in charts.stacked_bars(matrix, "year").collect()}
    assert found == {"b": (2019, 2, 0, 2), "a": (2019, 0, 2, 2), "c": (2019, 3, 2, 5)}


def test_density_grid(spark):
    df = spark.createDataFrame([(0.1, -0.1), (0.4, -0.4), (0.6, 0.0)], "x double, y double")
    found = sorted(rows(charts.density_grid(df, "x", "y", 0.5, 0.5)))
    assert found == [(0, -1, 0.0, -0.5, 2), (1, 0, 0.5, 0.0, 1)]


def test_top_groups_break_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert rows(ranking.top_groups(df, ["v"], 2)) == [("c", 2), ("a", 1)]


def test_frequency_ranks(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("c", 1), (None, 3)], "v string, w int")
    found = sorted(rows(ranking.frequency_ranks(df, ["w", "v"])))
    assert found == [("v", "a", 1, 1), ("v", "b", 1, 2), ("v", "c", 2, 0), ("w", "1", 3, 0), ("w", "2", 1, 1), ("w", "3", 1, 2)]


def test_ranks_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") % 997).alias("v"))
    first = ranking.frequency_ranks(df.repartition(1), ["v"]).orderBy("rank")
    assert rows(first) == rows(ranking.frequency_ranks(df.repartition(8), ["v"]).orderBy("rank"))


def test_best_row_is_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "seq int, f1 double")
    assert rows(ranking.best_row(df, "f1", "seq")) == [(1, 0.9)]
    assert [r.bestModel for r in ranking.mark_best(df, "f1", "seq").orderBy("seq").collect()] == [0.0, 1000.0, 0.0]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "year int, type string")
    assert rows(counts.crosstab(empty, "year", "type")) == []
    assert rows(ranking.frequency_ranks(empty, ["type"])) == []


def test_reports(spark, incident_csv, tmp_path):
    reports = incident_reports(read_incidents(spark, incident_csv))
    assert rows(reports["types_by_year"]) == [(2019, 1, 1, 1), (2020, 0, 1, 2)]
    yearly = {r["Year"]: r for r in reports["type_trends"].collect()}
    assert yearly[2019]["THEFT"] == 1 and yearly[2019]["ROBBERY"] is None
    assert rows(reports["arrests_by_location"]) == [
        ("APARTMENT", 0, 1), ("STREET", 1, 1),
    ]
    assert len(rows(reports["largest_outcome_groups"])) == 5
    months = {r.x: r.label for r in reports["types_by_month_chart"].collect()}
    assert months["01"] == "Jan" and months["03"] == "Mar"
    names = write_reports(read_incidents(spark, incident_csv), str(tmp_path / "out"))
    assert (tmp_path / "out" / "types_by_year").exists() and len(names) == 11
