import pytest
from pyspark.sql import functions as F

from blotter.functions import as_percentage, hour_of, index_name, month_label, month_of, occurred_at, tokenize, total
from blotter.functions.names import column, literal


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_hours_with_one_and_two_digits(spark):
    rows = [
        ("04/16/2020 5:00:00 AM", 5),
        ("05/07/2020 10:24:00 AM", 10),
        ("1/2/2020 12:00:00 AM", 0),
        ("01/02/2020 12:00:00 PM", 12),
        ("01/02/2020 11:59:59 PM", 23),
        ("gibberish", None),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "text string, hour int")
    assert all(a == b for a, b in values(df, hour_of(F.col("text")), "hour"))


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("03/08/2020 2:30:00 AM",), ("11/01/2020 1:30:00 AM",), ("13/45/2020 1:30:00 AM",)], "text string")
        assert [r.h for r in df.select(hour_of(F.col("text")).alias("h")).collect()] == [2, 1, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_occurred_at_has_no_zone(spark):
    df = spark.createDataFrame([("03/08/2020 2:30:00 AM",)], "text string")
    assert df.select(occurred_at(F.col("text")).alias("t")).schema["t"].dataType.typeName() == "timestamp_ntz"


def test_months(spark):
    df = spark.createDataFrame([("05/07/2020 10:24:00 AM",), ("  12/07/2020 1:00:00 AM",), (None,)], "text string")
    assert values(df, month_of(F.col("text"))) == [("05",), ("12",), (None,)]
    labels = df.select(month_label(month_of(F.col("text"))).alias("m"))
    assert [r.m for r in labels.collect()] == ["May", "Dec", None]
    bad = spark.createDataFrame([("13",), ("x",)], "m string")
    assert values(bad, month_label(F.col("m"))) == [(None,), (None,)]


def test_tokens(spark):
    rows = [
        ("PARKING LOT/GARAGE(NON.RESID.)", ["parking", "lot", "garage", "non", "resid"]),
        ("DRIVER'S  LICENSE", ["driver's", "license"]),
        ("a\tb\nc", ["a", "b", "c"]),
        (" - ", []),
        ("", []),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "text string, words array<string>")
    assert all(a == b for a, b in values(df, tokenize(F.col("text")), "words"))


def test_numbers(spark):
    df = spark.createDataFrame([(0.98765, [0.5, 0.25])], "share double, parts array<double>")
    assert values(df, as_percentage(F.col("share")), total(F.col("parts"))) == [(98.77, 0.75)]


def test_names(spark):
    assert index_name("Location Description") == "i_location_description"
    odd = "a.b `c`"
    df = spark.createDataFrame([(1,)], f"x int").withColumnRenamed("x", odd)
    assert df.select(column(odd)).first()[0] == 1
    assert spark.sql(f"select {literal(chr(39) + ' and ' + chr(92))}").first()[0] == "' and \\"
