import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from blotter.llm import trie

FIELDS = "conv_id long, turn int, role string, text string, base string, steps int, key string, depth int, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "b", 1, "k", 2, "x") for r in rows], FIELDS)


def sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in found.items()}


def rebuilt(own):
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return found


def nodes(convs):
    """By definition: every distinct beginning, its members and its descendants."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for path, within in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in members if p}
        ends = ",".join(str(c) for c in sorted(within) if len(convs[c]) == len(path))
        rows.add((
            min(within), len(path), min(members[path[:-1]]) if path else None, len(within), sum(1 for p in below if len(p) == len(path) + 1),
            sum(p not in parents for p in below), sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def random_rows(seed, count, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * count), count):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


def found(trie_rows):
    rows = [tuple(r) for r in trie_rows.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("partitions,fan,batch,seed", [(1, 32, 10000, 1), (9, 2, 3, 2)])
def test_equals_definition(spark, monkeypatch, partitions, fan, batch, seed):
    monkeypatch.setattr(trie, "FAN", fan)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = random_rows(seed, 150, ["a", "b", "", None, "über"])
        same = [(c, t, "user", "copy %d" % t) for c in range(1000, 1060) for t in range(2)]  # a third of all, alike
        rows += same + [(c, 0, "user", "copy 0") for c in range(2000, 2010)] + [(None, 1, "user", "nobody")] + rows[:3]
        df = table(spark, rows)
        assert found(trie.prefix_trie(trie.sequences(df))) == nodes(sequences(rows))
        assert found(trie.prefix_trie(trie.rebuilt_sequences(df))) == nodes(rebuilt(sequences(rows)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_conversations_and_deep_branches(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    rows = [(c, t, "user", "x" * (t % 3) if t < 60 - c else f"{c} {t}") for c in range(60) for t in range(60)]
    rows += [(100, t, "user", "y") for t in range(3000)] + [(101, t, "user", "y") for t in range(1500)] + [(102, 0, "user", "z" * 1_000_000)]
    assert found(trie.prefix_trie(trie.sequences(table(spark, rows)))) == nodes_fast(sequences(rows))


def nodes_fast(convs):
    """As :func:`nodes`, by ids of beginnings, for long conversations."""
    children, ids = defaultdict(dict), {}
    members, ends, size, parent, depth = defaultdict(list), defaultdict(list), {0: 0}, {0: None}, {0: 0}
    for c in sorted(convs):
        at = 0
        members[0].append(c)
        for turn in convs[c]:
            at = children[at].setdefault(turn, len(size)) if turn in children[at] else new(children, at, turn, size, parent, depth)
            members[at].append(c)
        ends[at].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(size, key=lambda n: -depth[n]):
        leaves[node] = leaves[node] or 1
        saved[node] += (len(members[node]) - 1) * size[node]
        if parent[node] is not None:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return {
        (min(members[n]), depth[n], None if parent[n] is None else min(members[parent[n]]), len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in size
    }


def new(children, at, turn, size, parent, depth):
    node = len(size)
    children[at][turn], size[node], parent[node], depth[node] = node, len(turn[1].encode()), at, depth[at] + 1
    return node


def test_nothing_and_turnless(spark):
    assert found(trie.prefix_trie(trie.rebuilt_sequences(table(spark, [])))) == set()
    turnless = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:4]  # one turn, which gives way to none
    rows = [(c, 0, "user", "a") for c in turnless]
    assert found(trie.prefix_trie(trie.rebuilt_sequences(table(spark, rows)))) == nodes(rebuilt(sequences(rows)))
    assert len(nodes(rebuilt(sequences(rows)))) == 1


def test_union_find_alone():
    """A chain of contractions gives what one contraction of everything gives."""
    rng = random.Random(5)
    for _ in range(200):
        keys = sorted({"".join(rng.choice("ab") * trie.DIGEST for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 12))})
        edges = [trie.common_turns(a, b) for a, b in zip(keys, keys[1:])]

        def parts(some):
            import numpy as np

            return [trie._Part(len(k) // trie.DIGEST, 1, keys.index(k), np.ones(len(k) // trie.DIGEST, np.int64), k) for k in some]

        at_once, closed = [], []
        trie.contract(parts(keys), edges, True, at_once)
        left, kept = [], []
        for i, part in enumerate(parts(keys)):
            left.append(part)
            if i:
                kept.append(edges[i - 1])
            left, kept = trie.contract(left, kept, False, closed)
        trie.contract(left, kept, True, closed)
        assert sorted(c[:8] for c in closed if c[1] < c[2]) == sorted(c[:8] for c in at_once)
