import gzip
import hashlib
import os

from pyspark.sql import functions as F

from blotter.llm.warc import read_archive, records, write_archive

FIELDS = "page_id long, url string, html string, record_type string"


def write(spark, tmp_path, rows):
    path = str(tmp_path / "archive")
    write_archive(spark.createDataFrame([(*r, "clash") for r in rows], FIELDS), path)
    return path


ROWS = [
    (7, "http://a/x\r\ny", "é" * 50), (3, None, "é" * 50), (9, "http://b", "é" * 50), (1, "u", "x" * 99), (2, "u", "x" * 99),
    (4, "v", None), (5, "v", ""), (6, "w", "<p>\r\n\r\n</p>" * 20000), (None, "z", "é" * 50), (8, "w", "a\r\n\r\nb"),
]


def test_round_trip(spark, tmp_path):
    path = write(spark, tmp_path, ROWS)
    found = {r.record_id: r for r in read_archive(spark, path).collect()}
    assert len(found) == len(ROWS)
    for id_, _, html in ROWS:
        r, payload = found[None if id_ is None else str(id_)], (html or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == payload and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == "3"
    assert {k for k, r in found.items() if r.record_type == "revisit"} == {"7", "9", None}


def test_filters_are_answered_by_the_headers(spark, tmp_path, capsys):
    path = write(spark, tmp_path, ROWS)
    revisits = read_archive(spark, path).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.record_id for r in revisits.collect()] == ["7"]
    plan = revisits._jdf.queryExecution().optimizedPlan().toString()
    assert "record_type" in plan and "= revisit" not in plan
    assert read_archive(spark, path).filter(F.col("record_id").isin("1", "8")).count() == 2
    assert read_archive(spark, path, payload=False).filter("payload is not null").count() == 0


def test_files_are_plain_gzip_and_may_be_empty(spark, tmp_path):
    path = write(spark, tmp_path, ROWS)
    text = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz"))
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)
    empty = write(spark, tmp_path / "none", [])
    assert read_archive(spark, empty).count() == 0


def test_writing_again_keeps_what_was_written(spark, tmp_path):
    path = write(spark, tmp_path, ROWS)
    (tmp_path / "archive" / "lost-attempt.warc.gz").write_bytes(b"not listed")
    write(spark, tmp_path, [(100, "new", "a page"), (101, "new", "x" * 200), (102, "new", "x" * 200)])
    found = read_archive(spark, path).collect()
    assert sorted(r.record_id or "" for r in found) == sorted([*("" if r[0] is None else str(r[0]) for r in ROWS), "100", "101", "102"])
    assert {r.record_id for r in found if r.record_type == "revisit"} == {"7", "9", None, "102"}
    records(spark.createDataFrame([(5, "u", "only this", "clash")], FIELDS)).write.format("warc").mode("overwrite").save(path)
    assert [r.record_id for r in read_archive(spark, path).collect()] == ["5"]
