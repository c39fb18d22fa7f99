import csv
import glob

import pytest
from pyspark.sql import functions as F

from blotter.operators.columns import schema_rows, to_canonical
from blotter.operators.filters import drop_incomplete
from blotter.plans.tables import clean, encode, write_canonical
from blotter.schema import INCIDENT_FIELDS
from blotter.operators.positions import with_source_position
from blotter.sources import export_batches, read_incidents, read_table, with_batches, write_results, write_table


def test_explicit_schema_keeps_codes(spark, incident_csv):
    df = read_incidents(spark, incident_csv)
    assert df.columns == INCIDENT_FIELDS
    by_id = {r["ID"]: r for r in df.collect()}
    assert by_id[2]["IUCR"] == "90X" and by_id[1]["IUCR"] == "117"
    assert by_id[2]["Description"] == "WITH A STICK, AT NIGHT"
    assert by_id[5]["District"] is None and by_id[6]["Location Description"] is None


def test_bad_numbers_are_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\ntwo,y\n")
    rows = read_incidents(spark, str(tmp_path / "t.csv"), "a int, b string").orderBy("b").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (None, "y")]


def test_inferred_types(spark, incident_csv):
    types = dict(read_table(spark, incident_csv).dtypes)
    assert types["ID"] == "int" and types["Latitude"] == "double" and types["Arrest"] == "boolean"
    assert types["IUCR"] == "string"


def test_canonical_table(spark, incident_csv, tmp_path):
    df = to_canonical(read_incidents(spark, incident_csv))
    assert dict(df.dtypes)["Arrest"] == "boolean" and dict(df.dtypes)["District"] == "int"
    row = df.filter("ID = 3").first()
    assert row["occurred_at"].hour == 12 and row["Longitude"] == -20.63
    write_canonical(read_incidents(spark, incident_csv), str(tmp_path / "canonical"))
    back = spark.read.parquet(str(tmp_path / "canonical"))
    assert back.count() == 6
    assert "PartitionFilters: [isnotnull(Year" in back.filter("Year = 2020")._jdf.queryExecution().toString()
    assert schema_rows(back).count() == 18


def test_clean_drops_columns_before_rows(spark):
    raw = spark.createDataFrame(
        [(1, None, "a"), (2, "b", "N/A"), (3, "b", None), (4, "b", "NASA")], "ID int, Beat string, Block string"
    )
    assert [tuple(r) for r in clean(raw).orderBy("ID").collect()] == [(1, "a"), (4, "NASA")]


def test_null_tokens(spark):
    tokens = ["", "NA", "N/A", "NaN", "null"]
    rows = [(i, t, 1.0) for i, t in enumerate([*tokens, "NOT NA", None])] + [(9, "x", float("nan"))]
    df = spark.createDataFrame(rows, "id int, text string, number double")
    assert [r.id for r in drop_incomplete(df, tokens).collect()] == [5]
    assert sorted(r.id for r in drop_incomplete(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_incomplete_filter_reaches_the_scan(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "p"))
    df = drop_incomplete(spark.read.parquet(str(tmp_path / "p")), ["NA"])
    plan = df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "IsNotNull(id)" in pushed and "Not(EqualTo(s,NA))" in pushed


def test_round_trip_with_awkward_text(spark, tmp_path):
    rows = [(1, 'say "hi", twice', [1, 2]), (2, "back\\slash", []), (3, "two\nlines", None), (4, None, [3])]
    df = spark.createDataFrame(rows, "id int, text string, seq array<int>")
    write_table(df, str(tmp_path / "t"))
    back = read_incidents(spark, str(tmp_path / "t"), "id int, text string, seq string", multiline=True)
    found = [tuple(r) for r in back.orderBy("id").collect()]
    assert found == [
        (1, 'say "hi", twice', "[1,2]"), (2, "back\\slash", "[]"), (3, "two\nlines", None), (4, None, "[3]"),
    ]


def test_results_are_one_file(spark, tmp_path):
    write_results(spark.range(10).repartition(4), str(tmp_path / "r"))
    assert len(glob.glob(str(tmp_path / "r" / "*.csv"))) == 1


@pytest.mark.parametrize("n,size,sizes", [(5, 10, [5]), (20, 10, [10, 10]), (21, 10, [10, 10, 1]), (0, 10, [])])
def test_batches(spark, tmp_path, n, size, sizes):
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v")).repartition(3)
    out = str(tmp_path / "b")
    export_batches(spark, df, out, ["key"], size)
    seen = []
    for i, expected in enumerate(sizes, start=1):
        files = glob.glob(f"{out}/Batch={i}/*.csv")
        assert len(files) == 1
        with open(files[0]) as f:
            rows = list(csv.DictReader(f))
        assert len(rows) == expected and list(rows[0]) == ["key", "v"]
        seen += [int(r["key"]) for r in rows]
    assert seen == list(range(n))
    assert len(glob.glob(f"{out}/Batch=*")) == len(sizes)


def test_batches_split_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("key"))
    sizes = with_batches(df, ["key"], 700).groupBy("Batch").count().orderBy("Batch").collect()
    assert [r["count"] for r in sizes] == [700, 700, 700, 700, 200]


def test_batches_from_a_file(spark, incident_csv, tmp_path):
    export_batches(spark, incident_csv, str(tmp_path / "b"), ["ID"], 4, index=True)
    with open(glob.glob(str(tmp_path / "b" / "Batch=2" / "*.csv"))[0]) as f:
        rows = list(csv.DictReader(f))
    assert [(r["index"], r["ID"]) for r in rows] == [("4", "5"), ("5", "6")]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_batches_in_source_order(spark, tmp_path, kind):
    """Several files, each read in several splits, with repeated rows and an empty file."""
    path, rows = str(tmp_path / "rows"), []
    for i in range(4):
        part = [((i * 7919 + j * 104729) % 1000, f"row {i} {j % 5}" * 9) for j in range(0 if i == 2 else 900)]
        rows += part
        df = spark.createDataFrame(part, "k int, v string").coalesce(1)
        getattr(df.write.mode("append").option("header", "true").option("parquet.block.size", 1 << 14), kind)(f"{path}/{i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 13)
    try:
        read = spark.read.option("recursiveFileLookup", "true").option("header", "true").schema("k int, v string")
        df = getattr(read, kind)(path)
        assert df.rdd.getNumPartitions() >= 4
        placed = with_batches(df, None, 500).orderBy("__position").collect()
        assert [(r["k"], r["v"]) for r in placed] == rows
        assert [r["__position"] for r in placed] == list(range(len(rows)))
        assert [r["Batch"] for r in placed] == [i // 500 + 1 for i in range(len(rows))]
        some = with_source_position(df.filter("k % 2 = 0").select("v"), "at").orderBy("at")
        assert [r["v"] for r in some.collect()] == [v for k, v in rows if k % 2 == 0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_batches_in_plain_files(spark, incident_csv, tmp_path):
    export_batches(spark, incident_csv, str(tmp_path / "b"), ["ID"], 4, flat=True)
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith((".", "_"))) == ["Batch_1.csv", "Batch_2.csv"]
    assert read_table(spark, str(tmp_path / "b")).count() == 6


def test_encode(spark, incident_csv):
    encoded = encode(clean(read_incidents(spark, incident_csv)))
    assert "Primary Type" not in encoded.columns
    rows = {r["ID"]: r for r in encoded.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    # street and theft occur twice, then the others by alphabet.
    order = ["street", "theft", "apartment", "assault", "battery", "fence", "garden", "shed"]
    ids = {w: i for i, w in enumerate(order, start=1)}
    assert rows[3]["Loc_Descr_Int"] == [ids["garden"], ids["shed"], ids["fence"]]
    assert rows[1]["Loc_Descr_Int"] == [1] and rows[1]["Prim_Type_Int"] == [2]


def test_kind_of_files(spark, incident_csv, tmp_path):
    write_canonical(read_incidents(spark, incident_csv), str(tmp_path / "typed"))
    assert read_incidents(spark, str(tmp_path / "typed")).count() == 6
    assert read_incidents(spark, [str(incident_csv), str(incident_csv)]).count() == 12
    (tmp_path / "typed" / "Year=2020" / "more.csv").write_text("ID\n1\n")
    with pytest.raises(ValueError, match="name the source"):
        read_incidents(spark, str(tmp_path / "typed"))
    (tmp_path / "empty").mkdir()
    assert read_incidents(spark, str(tmp_path / "empty")).count() == 0
