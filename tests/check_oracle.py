"""Run every query and its SQL side by side: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    """Empty if both agree in column names, row count and every value, types included."""
    df = run(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    for a, b in zip(rows_of(df.columns, ours), rows_of(names, theirs)):
        if repr(a) != repr(b):
            return f"{a!r} != {b!r}"
    return ""


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from blotter.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            if name in sql:
                found = compare(spark, con, sf_dir, run, sql[name])
            else:
                found = "" if run(spark, sf_dir).collect() else "no rows"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(found)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if found else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {found}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
