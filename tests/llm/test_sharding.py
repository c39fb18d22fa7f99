from collections import Counter, defaultdict

from llm_cases import documents, nothing

from blotter.llm.sharding import shard


def sizes(rows):
    return [len((r.text or "").encode()) + 16 for r in rows]


def check(df, shards):
    out = shard(df, shards)
    added = out.columns[-3:]
    rows = out.collect()
    own = sizes(df.collect())
    total, slots = Counter(), defaultdict(list)
    for r, size in zip(rows, sizes(rows)):
        assert r[added[0]] == size
        total[r[added[1]]] += size
        slots[r[added[1]]].append(r[added[2]])
    assert sorted(sizes(rows)) == sorted(own)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(total[s] - sum(own) / shards) <= max(own) + 0.002 * sum(own) / shards + 1 for s in range(shards))
    return rows


def test_awkward_rows(spark):
    docs = documents(spark)
    out = shard(docs, 4)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-3:] == ["_size", "_shard", "slot"]
    check(docs, 4)
    assert shard(nothing(spark)).count() == 0


def test_even_bytes_with_a_very_common_text(spark):
    rows = [(i, "common " * 5 if i % 3 else f"text {i} " * (i % 11)) for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 40)


def test_equal_texts_stand_together(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(500)], "doc_id long, text string")
    where = defaultdict(set)
    for r in check(df, 5):
        where[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 4  # one at each border
