import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from blotter.operators.scaling import assemble
from blotter.operators.splits import train_test_split, with_folds
from blotter.plans import subtrees
from blotter.plans.tuning import cross_validate, sweep, tree


@pytest.fixture(scope="module")
def ready(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.random(), float(rnd.randrange(6)), float(rnd.randrange(300))) for i in range(2500)]
    rows = [(*r, float((int(r[1] * 8) * r[2] + r[3] // 70 + (rnd.random() < 0.3)) % 3)) for r in rows]
    df = spark.createDataFrame(rows, "ID long, a double, b double, c double, i_type double")
    return assemble(df, ["a", "b", "c"], "scaledFeatures").select("ID", "scaledFeatures", "i_type")


def test_sweep_in_parts_equals_whole_trees(ready, monkeypatch):
    """Trees grown in parts give the F1 of Spark's trees, and Spark's learner grows only their tops."""
    train, test = train_test_split(ready, ["ID"], 30, 1234)
    monkeypatch.setattr(subtrees, "_NODES", 7)
    fits = []
    fit = DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, *a: fits.append(self.getMaxDepth()) or fit(self, *a))
    points = [(0, 1), (1, 1), (2, 3), (5, 1), (25, 3), (30, 1)]
    rows = sweep(train, test, points, whole_rows=0).results.collect()
    assert max(fits) <= 2
    evaluator = MulticlassClassificationEvaluator(labelCol="i_type", metricName="f1")
    for r, (depth, leaf) in zip(rows, points):
        alone = fit(tree(maxDepth=depth, minInstancesPerNode=leaf), train)
        assert r["training f1"] == pytest.approx(evaluator.evaluate(alone.transform(train)), abs=1e-12)
        assert r["testing f1"] == pytest.approx(evaluator.evaluate(alone.transform(test)), abs=1e-12)


def test_cross_validation_in_parts(ready):
    options = {"depths": [12, 3], "leaf_sizes": [2, 5], "folds": 2}
    tuned = cross_validate(ready, whole_rows=0, fit_best=False, **options)
    assert tuned.best is None
    whole = cross_validate(ready, fit_best=False, **options).results.collect()
    for a, b in zip(tuned.results.collect(), whole):
        # The candidate splits are those of all folds, where whole trees take those of their own.
        assert a[:2] == b[:2] and a.avg_f1 == pytest.approx(b.avg_f1, abs=0.05)


def test_candidate_splits():
    assert list(subtrees.candidate_splits(np.array([3.0, 1.0, 1.0]))) == [2.0]
    assert len(subtrees.candidate_splits(np.arange(1000.0))) == 31
    assert len(subtrees.candidate_splits(np.ones(5))) == 0


def _stump() -> subtrees._Top:
    """A split of the first feature after bin 1, whose right leaf does not go on."""
    feature, last_left = np.array([0, 0, 0]), np.array([1.5, 0.0, 0.0])
    following, leaf = np.array([[1, 2], [1, 1], [2, 2]]), np.array([0, 0, 1], dtype=np.uint16)
    return subtrees._Top(feature, last_left, following, leaf, 1, [[0.0, 0.0], [0.0, 2.0]], [True, False])


def test_rows_of_a_leaf_travel_together():
    """Of a task's rows each leaf gets one value, with the bins, label and flag of each row in order, or counts alone."""
    bins, label, learn = [b"\0\7", b"\2\1", b"\1\3", b"\2\0"], [2.0, 1.0, 0.0, 1.0], [True, False, False, True]
    batches = [
        pa.RecordBatch.from_pydict({"label": label[at], "learn_0": learn[at], "bins": bins[at]}) for at in (slice(0, 3), slice(3, 4))
    ]
    sent = [r for batch in subtrees._sent([_stump()], 2, 3)(iter(batches)) for r in batch.to_pylist()]
    assert [(r["tree"], r["leaf"]) for r in sent] == [(0, 0), (0, 1)]
    rows = np.frombuffer(sent[0]["rows"], dtype=subtrees._row_type(2))
    assert [(r["bins"].tolist(), int(r["label"]), bool(r["learn"])) for r in rows] == [([0, 7], 2, True), ([1, 3], 0, False)]
    assert np.frombuffer(sent[1]["rows"], dtype=np.int64).tolist() == [0, 1, 0, 0, 1, 0]


def test_tasks_need_no_module_of_the_library():
    """What is sent to Python workers can be loaded where the library is not installed."""
    sent = cloudpickle.dumps(subtrees._sent([_stump()], 2, 3))
    load = "import pickle, sys; pickle.load(sys.stdin.buffer); assert not any(m.startswith('blotter') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", f"from pyspark import cloudpickle; {load}"], input=sent, cwd="/", capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
