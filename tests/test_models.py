import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from blotter.operators import charts, scores
from blotter.operators.scaling import assemble
from blotter.operators.splits import train_test_split
from blotter.plans.depths import counts_by_depth
from blotter.plans.outcomes import Forest, Settings, train_outcome
from blotter.plans.tasks import BEST_MARK, CV_DEPTHS, CV_LEAF_SIZES, SWEEP_GRID, TASKS, TYPE_FEATURES, Task
from blotter.plans.tuning import cross_validate, param_grid, sweep, tree, tune_type, type_features


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "label int, score double")


def test_roc_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(rnd.random() < 0.4, round(rnd.random(), 2)) for _ in range(500)]
    df = scored(spark, pairs)
    assert scores.roc_area(df).first()["auc"] == pytest.approx(brute_auc(pairs))
    points = scores.roc_points(df).orderBy("fpr", "tpr").collect()
    pos, neg = sum(y for y, _ in pairs), sum(not y for y, _ in pairs)
    assert points[0][:] == (0.0, 0.0, None) and (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    assert len(points) == len({s for _, s in pairs}) + 1
    for p in points[1:]:
        assert p.tpr == pytest.approx(sum(y and s >= p.threshold for y, s in pairs) / pos)
        assert p.fpr == pytest.approx(sum((not y) and s >= p.threshold for y, s in pairs) / neg)


@pytest.mark.parametrize(
    "pairs,area",
    [
        ([(1, 0.9), (0, 0.1)], 1.0),
        ([(1, 0.1), (0, 0.9)], 0.0),
        ([(1, 0.5), (0, 0.5)], 0.5),
        ([(1, 0.5), (1, 0.7)], None),
    ],
)
def test_roc_area_corners(spark, pairs, area):
    assert scores.roc_area(scored(spark, pairs)).first()["auc"] == area


def test_roc_of_one_class_has_no_rate(spark):
    points = scores.roc_points(scored(spark, [(1, 0.5), (1, 0.7)])).collect()
    assert {p.fpr for p in points} == {None} and {p.tpr for p in points} == {0.0, 0.5, 1.0}


def test_roc_of_one_class_among_three(spark):
    rows = [(0, 0.9), (1, 0.8), (2, 0.7), (1, 0.2), (0, 0.1), (None, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert scores.roc_area(df, positive=1).first()["auc"] == pytest.approx(brute_auc([(y == 1, s) for y, s in rows if y is not None]))
    assert all(0 <= p.fpr <= 1 and 0 <= p.tpr <= 1 for p in scores.roc_points(df, positive=1).collect())


def test_metrics_of_given_predictions(spark):
    data = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 2 + [(2.0, 0.0)]
    counts = scores.prediction_counts(spark.createDataFrame(data, "label double, prediction double"))
    assert scores.accuracy(counts).first()[0] == pytest.approx(0.7)
    f1 = (7 * (10 / 13) + 2 * (4 / 6) + 1 * 0.0) / 10
    assert scores.weighted_f1(counts).first()[0] == pytest.approx(f1)
    matrix = [tuple(r) for r in scores.confusion_matrix(counts, [0.0, 1.0, 2.0]).collect()]
    assert matrix == [(0.0, 5, 2, 0), (1.0, 0, 2, 0), (2.0, 1, 0, 0)]
    heat = charts.confusion_heatmap(scores.confusion_matrix(counts, [0.0, 1.0]), {0.0: "No", 1.0: "Yes", 2.0: "Both"})
    assert heat.columns == ["true_label", "Predicted No", "Predicted Yes", "Predicted Both"]
    assert [tuple(r) for r in heat.collect()] == [("No", 5, 2, 0), ("Yes", 0, 2, 0), ("Both", 1, 0, 0)]


def test_f1_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(3000).select(
        (F.hash("id") % 4 + 4).cast("double").alias("label"), (F.hash("id", F.lit(1)) % 5 + 5).cast("double").alias("prediction")
    )
    ours = scores.weighted_f1(scores.prediction_counts(df)).first()[0]
    assert ours == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(df), abs=1e-12)


def test_no_predictions(spark):
    counts = scores.prediction_counts(spark.createDataFrame([], "label double, prediction double"))
    assert scores.accuracy(counts).first()[0] is None and scores.weighted_f1(counts).first()[0] is None


def test_task_table():
    assert {n: len(t.features) for n, t in TASKS.items()} == {
        "arrest": 14, "domestic": 14, "district": 14, "district_pca": 14, "hour": 15, "hour_pca": 15,
    }
    for task in TASKS.values():
        assert task.label not in task.features and len(set(task.features)) == len(task.features)
    assert len(SWEEP_GRID) == 90 and len(CV_DEPTHS) * len(CV_LEAF_SIZES) == 12


@pytest.fixture(scope="module")
def separable(spark):
    """The label follows from the colour, except for one row in ten."""
    i = F.col("id")
    colour = F.when(F.hash(i) % 3 == 0, "red").otherwise("blue")
    return spark.range(1200).select(
        i.alias("ID"),
        colour.alias("Colour"),
        (F.hash(i, F.lit(2)) % 50).cast("string").alias("Noise"),
        (i % 90).cast("string").alias("Latitude"),
        F.when((colour == "red") != (F.hash(i, F.lit(5)) % 10 == 0), "TRUE").otherwise("FALSE").alias("Flag"),
    )


def test_near_unique_features_do_not_spoil_test_rows(spark):
    i = F.col("id")
    df = spark.range(1500).select(
        i.alias("ID"), F.concat(F.lit("d"), i).alias("Date"), (F.hash(i) % 4).cast("string").alias("Ward"),
        F.when((F.hash(i) % 4).isin(0, 1), "TRUE").otherwise("FALSE").alias("Flag"),
    )
    task = Task("flag", "Flag", ["Date", "Ward"], None, binary=True)
    outcome = train_outcome(df, task, Settings(forest=Forest(trees=10, depth=6)))
    assert outcome.accuracy().first()[0] > 0.95
    assert set(outcome.charts()) == {"confusion_chart", "roc_chart"}


def test_bounded_fit_does_not_depend_on_the_partitions(spark, monkeypatch):
    """The learner's partitions follow the rows it is fitted on, and the forest is the same however the table is cut."""
    rnd = random.Random(6)
    rows = [(i, str(rnd.randrange(30)), str(rnd.randrange(9)), rnd.choice("TF")) for i in range(600)]
    df = spark.createDataFrame(rows, "ID long, a string, b string, Flag string")
    settings = Settings(forest=Forest(trees=6, depth=8), labelled_rows=300)
    fit, partitions, found = RandomForestClassifier.fit, [], []
    seen = lambda self, rows: partitions.append(rows.rdd.getNumPartitions()) or fit(self, rows)
    monkeypatch.setattr(RandomForestClassifier, "fit", seen)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for pieces in (2, 11):
            outcome = train_outcome(df.repartition(pieces, "ID"), Task("flag", "Flag", ["a", "b"], None, binary=True), settings)
            found.append(sorted((r.ID, r.predicted, r.score) for r in outcome.predictions.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert partitions == [4, 4] and found[0] == found[1]


def test_missing_and_malformed_numbers_count_as_the_mean(spark):
    rows = [(i, None if i % 9 == 0 else "?" if i % 9 == 1 else str(i % 5), "TRUE" if i % 5 > 2 else "FALSE") for i in range(400)]
    df = spark.createDataFrame(rows, "ID long, Latitude string, Flag string")
    settings = Settings(forest=Forest(trees=5, depth=4), numeric=("Latitude",), labelled_rows=200)
    outcome = train_outcome(df, Task("flag", "Flag", ["Latitude"], None, binary=True), settings)
    assert outcome.predictions.count() == train_test_split(df, ["ID"], 25)[1].count()


def test_roc_corners(spark):
    """Straight runs that cross blocks keep their ends; the area under the corners is that under all points."""
    rnd = random.Random(6)
    pairs = [(k % 2, i / 1000) for i in range(300) for k in (0, 1)]  # a long straight run
    pairs += [(rnd.random() < 0.5, 1 + round(rnd.random(), 2)) for _ in range(400)]
    ranked = scores.ranked_scores(scored(spark, pairs))
    every, kept = ([(r.fpr, r.tpr) for r in scores.curve(x).orderBy("fpr", "tpr").collect()] for x in (ranked, scores.corners(ranked)))
    counts = sorted((r.score, r.pos, r.neg) for r in ranked.collect())[::-1]
    expected = sum(
        i in (0, len(counts) - 1) or counts[i][1:] != counts[i + 1][1:] for i in range(len(counts))
    )
    assert len(kept) == expected + 1 < len(every) - 250 and set(kept) <= set(every)

    def under(points):
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

    assert under(kept) == pytest.approx(under(every)) == pytest.approx(scores.area(ranked).first()["auc"])
    one = scores.ranked_scores(scored(spark, [(1, 0.5), (0, 0.5)]))
    assert scores.corners(one).count() == 1


@pytest.mark.parametrize(
    "components,options",
    [(None, {}), (3, {"rescale": True, "fit_on": "train"}), (None, {"numeric": ("Latitude",), "exclude": ("Noise",)})],
)
def test_forest_beats_the_majority(separable, components, options):
    task = Task("flag", "Flag", ["Colour", "Noise", "Latitude"], components, binary=True)
    outcome = train_outcome(separable, task, Settings(forest=Forest(trees=10, depth=5), **options))
    test_rows = train_test_split(separable, ["ID"], 25)[1]
    n = test_rows.count()
    majority = max(r["count"] for r in test_rows.groupBy("Flag").count().collect()) / n
    assert outcome.predictions.count() == n
    assert outcome.accuracy().first()[0] > majority
    assert sum(sum(r[1:]) for r in outcome.confusion().collect()) == n
    assert outcome.roc_area().first()["auc"] > 0.6
    assert len(outcome.explained) == (components or 0)
    named = outcome.predictions.join(test_rows, "ID").filter("actual != Flag").count()
    assert named == 0


def test_grid_order(spark):
    estimator = tree()
    grid = param_grid(estimator, [30, 25], [3, 5])
    assert [(m[estimator.maxDepth], m[estimator.minInstancesPerNode]) for m in grid] == [(30, 3), (30, 5), (25, 3), (25, 5)]


@pytest.fixture(scope="module")
def ready(spark):
    i = F.col("id")
    df = spark.range(900).select(
        i.alias("ID"), (i % 10).cast("double").alias("a"), (i % 7).cast("double").alias("b"),
        F.when((i % 10 > 4) & (i % 7 > 2), 1.0).otherwise(0.0).alias("i_type"),
    )
    return assemble(df, ["a", "b"], "scaledFeatures").select("ID", "scaledFeatures", "i_type")


def test_cross_validation(ready):
    train, test = train_test_split(ready, ["ID"], 20, 1234)
    tuned = cross_validate(train, depths=[1, 3], leaf_sizes=[1, 200], folds=3, test=test)
    rows = tuned.results.collect()
    assert tuned.results.columns == ["max_depth", "minInstancesPerNode", "avg_f1", "bestModel"]
    assert [(r.max_depth, r.minInstancesPerNode) for r in rows] == [(1, 1), (1, 200), (3, 1), (3, 200)]
    assert [r.bestModel for r in rows] == [0.0, 0.0, float(BEST_MARK), 0.0]
    assert rows[2].avg_f1 == pytest.approx(1.0) and tuned.test_f1 == pytest.approx(1.0)


def test_sweep(ready):
    train, test = train_test_split(ready, ["ID"], 20, 1234)
    rows = sweep(train, test, [(1, 1), (2, 1), (3, 1)], parallelism=3).results.collect()
    assert [r.max_depth for r in rows] == [1, 2, 3]
    assert [r["Best Model"] for r in rows].count(BEST_MARK) == 1
    best = max(rows, key=lambda r: r["testing f1"])
    assert best["Best Model"] == BEST_MARK and rows[0]["training f1"] < best["training f1"]


def test_one_tree_for_all_depths(spark, monkeypatch):
    """A tree cut at a depth says what the tree fitted to that depth says, row counts and F1 alike."""
    rnd = random.Random(9)
    rows = [(i, float(rnd.randrange(8)), float(rnd.randrange(6)), float(rnd.randrange(20))) for i in range(1500)]
    df = spark.createDataFrame([(*r, float((r[1] * r[2] + r[3] // 7 + (rnd.random() < 0.2)) % 3)) for r in rows], "ID long, a double, b double, c double, i_type double")
    ready = assemble(df, ["a", "b", "c"], "scaledFeatures").select("ID", "scaledFeatures", "i_type")
    train, test = train_test_split(ready, ["ID"], 30, 1234)
    depths = [0, 3, 30]
    deep = tree(maxDepth=30, minInstancesPerNode=4).fit(train)
    counted = counts_by_depth(deep, test, "i_type", depths).collect()
    for depth in depths:
        alone = tree(maxDepth=depth, minInstancesPerNode=4).fit(train)
        own = {tuple(r) for r in scores.prediction_counts(alone.transform(test), "i_type").collect()}
        assert {(r.label, r.prediction, r.n) for r in counted if r.depth == depth} == own
    fits = []
    fit = DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, *a: fits.append(self.getMaxDepth()) or fit(self, *a))
    points = [(2, 1), (4, 6), (5, 1)]
    swept = sweep(train, test, points, parallelism=1).results.collect()
    assert sorted(fits) == [4, 5]
    evaluator = MulticlassClassificationEvaluator(labelCol="i_type", metricName="f1")
    for r, (depth, leaf) in zip(swept, points):
        alone = fit(tree(maxDepth=depth, minInstancesPerNode=leaf), train)
        assert (r.max_depth, r.minInstancesPerNode) == (depth, leaf)
        assert r["training f1"] == pytest.approx(evaluator.evaluate(alone.transform(train)), abs=1e-12)
        assert r["testing f1"] == pytest.approx(evaluator.evaluate(alone.transform(test)), abs=1e-12)
    fits.clear()
    cross_validate(train, depths=[6, 2], leaf_sizes=[1, 5], folds=3, parallelism=1)
    assert len(fits) == 2 * 3 + 1


def test_tune_type_fits_on_training_rows(spark):
    i = F.col("id")
    df = spark.range(400).select(
        i.alias("ID"),
        *[((i * k) % (k + 3)).cast("string").alias(f) for k, f in enumerate(TYPE_FEATURES, start=1)],
        F.when(i % 4 == 0, "THEFT").otherwise("ASSAULT").alias("Primary Type"),
    )
    tuned = tune_type(df, depths=[4], leaf_sizes=[2], folds=2)
    assert tuned.results.count() == 1 and 0 < tuned.test_f1 <= 1
    same = type_features(df).count()
    assert same == 400
