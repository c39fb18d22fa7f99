"""The command line, from raw file to result."""

import pytest
from conftest import HEADER, RECORDS
from pyspark.sql import functions as F

from blotter.__main__ import main
from blotter.operators.splits import train_test_split
from blotter.sources import read_table


def test_clean_encode_project(spark, incident_csv, tmp_path, capsys):
    main(["clean", incident_csv, str(tmp_path / "clean")])
    assert read_table(spark, str(tmp_path / "clean")).count() == 4
    main(["clean", incident_csv, str(tmp_path / "typed"), "--parquet"])
    assert dict(spark.read.parquet(str(tmp_path / "typed")).dtypes)["Arrest"] == "boolean"
    main(["report", str(tmp_path / "typed"), str(tmp_path / "report")])
    main(["report", str(tmp_path / "clean"), str(tmp_path / "same")])
    for name in ("named_types_by_year", "types_by_month"):
        typed, text = (read_table(spark, str(tmp_path / d / name)).collect() for d in ("report", "same"))
        assert typed == text and len(typed) > 1
    main(["encode", incident_csv, str(tmp_path / "encoded")])
    encoded = read_table(spark, str(tmp_path / "encoded"), infer=False)
    assert encoded.filter("ID = 1").first()["Loc_Descr_Int"] == "[1]"
    main(["project", str(tmp_path / "encoded"), str(tmp_path / "points")])
    assert read_table(spark, str(tmp_path / "points")).columns == ["ID", "pca1", "pca2"]
    assert "Explained variance" in capsys.readouterr().out


def test_batches_and_report(spark, incident_csv, tmp_path, capsys):
    main(["batches", incident_csv, str(tmp_path / "b"), "--size", "4"])
    batches = read_table(spark, str(tmp_path / "b"), infer=False)
    assert sorted((r["Batch"], r["ID"]) for r in batches.collect())[3:5] == [(1, "4"), (2, "5")]
    main(["report", incident_csv, str(tmp_path / "r")])
    assert "types_by_year" in capsys.readouterr().out.split()


@pytest.mark.parametrize("task", ["arrest", "hour"])
def test_outcome(spark, tmp_path, capsys, task):
    many = [f"{k}{r[r.index(','):]}" for k, r in enumerate(RECORDS * 20, start=1)]
    (tmp_path / "many.csv").write_text("\n".join([HEADER, *many]) + "\n")
    main(
        ["outcome", str(tmp_path / "many.csv"), str(tmp_path / "p"), "--task", task, "--trees", "5", "--depth", "4",
         "--exclude", "Block", "--explained", "0.8", "--rescale", "--labelled-rows", "80", "--charts", str(tmp_path / "charts")]
    )
    charts = {"confusion", "confusion_chart", *(["roc_chart"] if task == "arrest" else [])}
    assert {p.name for p in (tmp_path / "charts").iterdir()} == charts
    assert read_table(spark, str(tmp_path / "charts" / "confusion")).count() > 1
    predictions = read_table(spark, str(tmp_path / "p"))
    printed = capsys.readouterr().out
    assert ("ROC area" in printed) == ("Explained variance" in printed) == (task == "arrest")
    # One in six records has no readable time, so no hour to predict.
    assert predictions.count() == sum(1 for _ in expected_keys(spark, len(many), task))


def expected_keys(spark, n, task):
    keys = spark.range(1, n + 1).filter((F.col("id") % 6 != 0) | (task == "arrest"))
    return [r.id for r in train_test_split(keys, ["id"], 25)[1].collect()]
