import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blotter.operators.splits import train_test_split
from blotter.plans import deep_forests, outcomes
from blotter.plans.outcomes import Forest, Settings, train_outcome
from blotter.plans.tasks import TASKS, Task
from blotter.queries import models


def plain_tree(bins, label, weight, classes, levels):
    """(feature, last bin, left, right) or the classes of a leaf; leaves under one parent that say the same are one."""
    counts = np.bincount(label, weights=weight, minlength=classes)
    squares = lambda c: float(c @ c) / c.sum()
    best, at = 1e-9, None
    if levels and counts.max() < counts.sum():
        for f in range(bins.shape[1]):
            for b in range(int(bins[:, f].min()), int(bins[:, f].max())):
                left = np.bincount(label, weights=weight * (bins[:, f] <= b), minlength=classes)
                if 0 < left.sum() < counts.sum() and squares(left) + squares(counts - left) - squares(counts) > best + 1e-9:
                    best, at = squares(left) + squares(counts - left) - squares(counts), (f, b)
    if at is None:
        return counts
    goes_left = bins[:, at[0]] <= at[1]
    sides = [plain_tree(bins[m], label[m], weight[m], classes, levels - 1) for m in (goes_left, ~goes_left)]
    same = all(isinstance(s, np.ndarray) for s in sides) and sides[0].argmax() == sides[1].argmax()
    return counts if same else (*at, *sides)


def answer(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("classes,n,levels,size", [(2, 400, 30, 32), (2, 300, 4, 6), (5, 400, 30, 32), (5, 1500, 5, 4), (1, 20, 5, 3)])
def test_a_tree_is_that_of_plain_recursion(classes, n, levels, size):
    """Two features are both tried at every node, so nothing is left to chance but the weights."""
    rng = np.random.default_rng(n + classes)
    bins = rng.integers(0, size, (n, 2)).astype(np.uint8)
    # Weights that are odd and far apart leave no two splits equal.
    label, weight = rng.integers(0, classes, n), rng.integers(1, 250, n).astype(np.uint8)
    test = rng.integers(0, size, (200, 2)).astype(np.uint8)
    tree = plain_tree(bins, label, weight.astype(int), classes, levels)
    reached, counts = deep_forests.grown(bins, label, weight, test, classes, levels, np.random.default_rng(1), size)
    assert [counts[v].tolist() for v in reached] == [answer(tree, row).astype(int).tolist() for row in test]


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    """Of a value in one row of a thousand, all rows tell; parts of many values tell points of even shares."""
    monkeypatch.setattr(deep_forests, "_POINTS", 64)
    rows = spark.range(20_000).select(array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") == 777).cast("double"))).alias("v"))
    many, few = deep_forests.splits_of_all(rows, "v", 32)
    assert few.tolist() == [0.5] and len(many) == 31
    assert max(abs(t - 625 * i) for i, t in enumerate(many, start=1)) < 20_000 / 64 * 4


def test_draws_are_a_bootstrap():
    rows = np.arange(200_000)
    first, second = (deep_forests.draws(rows, tree, 42).astype(float) for tree in (0, 1))
    assert (deep_forests.draws(rows, 0, 42) == first).all()
    assert first.mean() == pytest.approx(1, abs=0.01) and first.var() == pytest.approx(1, abs=0.02)
    assert (first == 0).mean() == pytest.approx(np.exp(-1), abs=0.005) and abs(np.corrcoef(first, second)[0, 1]) < 0.01


@pytest.fixture(scope="module")
def cells(spark):
    """A label that only the row of a cell itself tells; rows without a key and with one key stand for themselves."""
    rnd = random.Random(11)
    label = {(x, y): rnd.randrange(3) for x in range(24) for y in range(24)}
    rows = [(None if i % 7 == 0 else i // 2, [float(x), float(y)], float(k), copy == 3) for copy in range(4) for i, ((x, y), k) in enumerate(label.items())]
    df = spark.createDataFrame(rows, "key long, x array<double>, label double, test boolean")
    return df.select("key", array_to_vector("x").alias("v"), "label", "test")


def test_parts_and_rounds_do_not_change_the_forest(cells):
    """Both features are tried at every node and no two rows of a leaf differ: each tree is one and the same tree."""
    found = []
    for leaf_rows, round_rows in ((10**9, 10**9), (400, 2_000)):
        votes = deep_forests.with_forest_votes(
            cells, "v", "label", ~F.col("test"), F.col("test"), 3, 4, 30, 42, 32, leaf_rows=leaf_rows, round_rows=round_rows
        )
        assert votes.columns == ["key", "test", "label", "prediction", "score"]
        found.append(sorted(map(repr, votes.collect())))
    assert len(found[0]) == 24 * 24 and all(f == found[0] for f in found)
    right = sum("label=0.0, prediction=0.0" in r or "label=1.0, prediction=1.0" in r or "label=2.0, prediction=2.0" in r for r in found[0])
    assert right > 0.9 * len(found[0])


def test_a_forest_of_one_class_says_it(cells):
    one = cells.withColumn("label", F.lit(0.0))
    votes = deep_forests.with_forest_votes(one, "v", "label", ~F.col("test"), F.col("test"), 1, 3, 5, 1, 32, leaf_rows=100)
    assert {(r.prediction, r.score) for r in votes.collect()} == {(0.0, 0.0)} and votes.count() == 24 * 24


def test_all_training_rows_are_learned_from(spark, monkeypatch):
    """The label of a row is told by a row of its own kind alone: a forest of 2,000 rows knows less than half of the kinds."""
    rnd = random.Random(5)
    kinds = [(x, y, rnd.choice("TF")) for x in range(70) for y in range(70)]
    rows = [(2 * i + copy, str(x), str(y), flag) for i, (x, y, flag) in enumerate(kinds) for copy in (0, 1)]
    df = spark.createDataFrame(rows, "ID long, a string, b string, Flag string")
    task = Task("flag", "Flag", ["a", "b"], None, binary=True)
    learned = []
    votes = deep_forests.with_forest_votes
    spy = lambda rows, vector, label, learn, *more: learned.append(rows.filter(learn).count()) or votes(rows, vector, label, learn, *more)
    monkeypatch.setattr(outcomes, "with_forest_votes", spy)
    outcome = train_outcome(df, task, Settings(forest=Forest(trees=15, bins=128)))
    train, test = train_test_split(df, ["ID"], 25)
    assert learned == [train.count()] and outcome.forest is None
    assert sorted(r.ID for r in outcome.predictions.collect()) == sorted(r.ID for r in test.collect())
    # Two rows of three have their other copy among the training rows; the others are guessed.
    assert outcome.accuracy().first()[0] > 0.75
    assert outcome.predictions.filter("not score between 0 and 1").count() == 0


def test_registered_models_bound_no_rows(spark, monkeypatch, tmp_path):
    """Every model query of every task learns from all training rows."""
    asked = []
    monkeypatch.setattr(models, "train_outcome", lambda df, task, settings: asked.append((task.name, settings)) or 1 / 0)
    monkeypatch.setattr(models, "incidents", lambda spark, sf_dir: None)
    from blotter.queries import QUERIES

    names = [n for n in QUERIES if n.startswith(("r1_", "r2_", "r3_", "r4_", "r5_hour", "r6_", "r7_", "r8_", "r9_"))]
    for name in names:
        with pytest.raises(ZeroDivisionError):
            QUERIES[name](spark, str(tmp_path))
    assert len(asked) == len(names) == 21 and {t for t, _ in asked} == set(TASKS)
    assert {s.labelled_rows for _, s in asked} == {None}
