from collections import Counter, defaultdict

import pytest
from llm_cases import documents, nothing, spaced
from pyspark.sql import functions as F

from blotter.llm.mixing import mix, mix_spans, mixed_rows, schedule, targets


def shared_out(sizes, weights=(5, 2, 1)):
    """Targets by resharing until none is above three times its source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 50}, {"a": 1, "b": 1000, "c": 7, "d": 500, "e": 2}, {"x": 9}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in targets(rows).collect()}
    assert found == pytest.approx(shared_out(sizes))


def test_schedule_covers_all_slots_evenly(spark):
    bounds = spark.createDataFrame([("a", 0, 40), ("b", 40, 60), (None, 60, 64), ("empty", 64, 64)], "source string, low long, high long")
    rows = schedule(bounds, 6).collect()
    assert sorted(r.slot for r in rows) == list(range(64))
    ranks = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        ranks[r.source].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())
    first = Counter(r.source for r in rows if r.slot < 32)
    assert abs(first["a"] - 20) <= 1 and abs(first["b"] - 10) <= 1 and abs(first[None] - 2) <= 1


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_what_is_taken(spark, block):
    docs = documents(spark)
    rows = mix(docs, block_words=block).collect()
    assert len(rows) == docs.count()
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert goal == pytest.approx(shared_out(sizes))
    assert all(abs(taken[s] - goal[s]) < 1.001 for s in goal)
    assert sorted(r["size"] for r in rows) == sorted(len(spaced(r.text)) for r in docs.collect())
    again = mix(docs.repartition(3), block_words=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_rows_of_the_mix(spark):
    docs = documents(spark)
    out = mixed_rows(docs)
    assert out.columns == docs.columns and out.filter(F.col("text").isNull()).count() == 0
    assert mix(nothing(spark)).count() == 0 and mixed_rows(nothing(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 100])
def test_order_of_the_mix(spark, block):
    """Slots, sources and blocks as the van der Corput points place them, spans in stream order, ``taken`` and ``first_slot`` from them."""
    docs = documents(spark)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(spaced(r.text))
    words = {s: int(t + 1e-9) for s, t in shared_out(sizes).items()}
    quota = {s: -(-w // block) for s, w in words.items()}
    total = sum(quota.values())
    bits = max(0, (total - 1).bit_length())
    expected, upto = [], 0
    for source in sorted(s for s in quota if s is not None) + [None]:
        low, high = (-(-(x * 2**bits) // total) for x in (upto, upto + quota[source]))
        upto += quota[source]
        slots = sorted(n for n in range(2**bits) if low <= int(format(n, f"0{bits}b")[::-1], 2) < high)
        expected += [(slot, source, i) for i, slot in enumerate(slots[: quota[source]])]
    spans = mix_spans(docs, block_words=block).collect()
    assert sorted({(r.slot, r.source, r.block) for r in spans}) == sorted(expected)
    held, taken, first = Counter(), Counter(), {}
    for r in spans:
        assert r.block * block <= r["at"] and r["at"] + r.words <= min((r.block + 1) * block, words[r.source])
        held[r.slot] += r.words
        taken[r.doc_id, r.tie, r.source] += r.words
        first[r.doc_id, r.tie, r.source] = min(r.slot, first.get((r.doc_id, r.tie, r.source), r.slot))
    assert all(held[slot] == min(block, words[s] - i * block) for slot, s, i in expected)
    found, slots = Counter(), {}
    for r in mix(docs, block_words=block).collect():
        found[r.doc_id, r.tie, r.source] += r.taken
        assert (r.first_slot is None) == (r.taken == 0)
        if r.taken:
            slots[r.doc_id, r.tie, r.source] = r.first_slot
    assert +found == taken and slots == first
