import os

import pytest
from llm_cases import alphanumeric, spaced

import corpus_pipeline
from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from blotter.staging import stage

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables here")


@needs_tables
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMOKE_DIR), name)
        kept[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns
    assert all(any(c.isalpha() for c in r.text) for r in kept["language"])
    sets = {}
    for r in kept["near_duplicates"]:
        words = spaced(r.text)
        own = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        assert all(10 * len(own & other) < 8 * len(own | other) for other in sets.values())
        sets[r.doc_id] = own
    lost = {r.doc_id for r in kept["language"]} - set(sets)
    assert lost
    items = [alphanumeric(r.text) for r in spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    clean = {r.doc_id for r in kept["decontamination"]}
    for r in kept["near_duplicates"]:
        words, hit = alphanumeric(r.text), set()
        for i in range(len(words) - 12):
            if tuple(words[i : i + 13]) in windows:
                hit.update(range(i, i + 13))
        assert (r.doc_id in clean) == (not hit or 20 * len(hit) < len(words))
    assert {r.doc_id for r in kept["mixing"]} <= clean
    assert len(kept["sharding"]) == len(kept["mixing"]) and {r.shard for r in kept["sharding"]} <= set(range(40))


def test_queries_are_registered():
    names = [n for n in queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())
