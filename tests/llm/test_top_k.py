import math
import random

import numpy as np
import pytest

from blotter.llm import top_k

FIELDS = "vec_id long, embedding array<double>, place long, rank int, segment string, asks int, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s", 3, "x") for i, v in rows], FIELDS)


def by_definition(rows, every, k):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for at, (q, v) in enumerate(kept):
        if q % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for j, (i, w) in enumerate(kept) if j != at)
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def found(spark, rows, every, k):
    df = table(spark, rows)
    return sorted(tuple(r) for r in top_k.top_k(df, df["vec_id"] % every == 0, k).collect())


def clustered(rng, count, dims=6):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.1) for x in middles[i % 5]]) for i in range(count)]


@pytest.mark.parametrize("segment,annulus,panel,turn", [(2048, 256, 128, 64), (40, 8, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, segment, annulus, panel, turn):
    for name, value in {"LEAST_SEGMENT": segment, "ANNULUS": annulus, "PANEL": panel, "TURN": turn, "SEGMENTS": 1000, "PIVOTS": 6}.items():
        monkeypatch.setattr(top_k, name, value)
    rng = random.Random(7)
    rows = clustered(rng, 400)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector for a third of all rows
    rows += [(None, rows[0][1]), (5000, None), (5001, [1.0, None, 1.0]), (5005, [float("nan")] * 6), (5010, [float("inf")] + [0.0] * 5), (5020, []), (5030, [2.0, -1.0]), (5040, [0.1] * 9)]
    rows += [rows[0], rows[5], (20, rows[3][1])]  # repeated rows and ids
    assert found(spark, rows, 10, 7) == by_definition(rows, 10, 7)


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([1e3, -1e9, 3.5e15, 2.0**60, 1e200, 0.25]) for _ in range(3)]) for i in range(60)]
    assert found(spark, rows, 5, 4) == by_definition(rows, 5, 4)


def test_few_and_none(spark):
    assert found(spark, [], 10, 20) == []
    assert found(spark, [(0, [1.0])], 10, 20) == []
    assert found(spark, [(0, [1.0]), (1, [2.0]), (3, [-2.0])], 10, 20) == [(0, 1, 1, 64 * 128), (0, 2, 3, -64 * 128)]
    assert found(spark, [(0, None), (10, [None])], 10, 20) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.rint(rng.normal(m, 3, (300, 8))) for m in rng.normal(0, 40, (6, 8))])
    pivots = top_k.choose_pivots(x, 6)
    far = top_k.distances(x, pivots)
    owner, queries = far.argmin(axis=1), x[::50]
    asked = 0
    for p in range(len(pivots)):
        mine = np.flatnonzero(owner == p)
        mine = mine[np.argsort(far[mine, p])]
        cell = top_k.Segment(p, mine, mine, far[mine, p], x[mine])
        above = top_k.bounds(queries, pivots, np.full(len(cell.starts), p), cell.low, cell.high, cell.most)
        scores = queries @ x.T
        for a, start in enumerate(cell.starts):
            assert (scores[:, mine[start : start + top_k.ANNULUS]].max(axis=1) <= above[:, a]).all()
            asked += int((above[:, a] >= np.sort(scores, axis=1)[:, -21]).sum())
    assert asked < 0.7 * len(queries) * len(pivots)


def test_every_annulus_that_may_matter_is_searched(spark):
    """The bound decides: without vectors it admits, results would be lost; what it refuses is never multiplied."""
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(0, 20, (600, 4)))
    pivots = np.zeros((1, 4))
    far = top_k.distances(x, pivots)[:, 0]
    order = np.argsort(far)
    cell = top_k.Segment(0, order, order, far[order], x[order])
    best = cell.search(x[:20], np.arange(20), np.full(20, -(2**63)), pivots, 5)
    for q in range(20):
        scores = sorted((-int(s), i) for i, s in enumerate(x[q] @ x.T) if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(*best[q][:2])] == scores
