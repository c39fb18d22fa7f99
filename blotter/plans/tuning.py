"""Tune a decision tree for the offence type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.operators.filters import drop_null_keys
from blotter.operators.indexing import FrequencyIndexer
from blotter.operators.ranking import mark_best
from blotter.operators.scaling import assemble, standardize
from blotter.operators.scores import prediction_counts, weighted_f1
from blotter.operators.splits import with_folds, with_split
from blotter.plans.depths import counts_by_depth
from blotter.plans.outcomes import label_attribute
from blotter.plans.tasks import BEST_MARK, CV_DEPTHS, CV_LEAF_SIZES, SWEEP_GRID, TYPE_FEATURES
from blotter.plans.subtrees import Step, counts_by_tree
from blotter.schema import KEY
from blotter.staging import stage

FEATURES, LABEL = "scaledFeatures", "i_type"
# On more rows than these trees are grown in parts (:mod:`blotter.plans.subtrees`).
WHOLE_ROWS = 100_000


@dataclass(frozen=True)
class Tuned:
    """``results`` has one row per parameter set, in the order of evaluation."""

    results: DataFrame
    best: Model | None
    test_f1: float | None = None


def type_features(
    df: DataFrame,
    features: list[str] = TYPE_FEATURES,
    label: str = "Primary Type",
    key: str = KEY,
    exclude: tuple[str, ...] = (),
    split: tuple[int, int] | None = None,
    fit_on: str = "all",
) -> DataFrame:
    """Key, scaled feature vector and label index, over staged indexes; with ``split`` also ``is_test``.

    Rows without a label are left out. ``split`` is the share of test rows in percent and a seed;
    the scaler is then fitted on the training rows, and with ``fit_on="train"`` the indexes too,
    under which all values that only test rows have share one number after the known ones, as
    missing values do.
    """
    used = [f for f in features if f not in exclude]
    inputs, outputs = [*used, label], [*[f"{f}_index" for f in used], LABEL]
    df = drop_null_keys(df.select(*[column(c) for c in dict.fromkeys([key, *inputs])]), [label])
    carried = [key]
    if split is not None:
        df, carried = with_split(df, [key], *split), [key, "is_test"]
    in_training = ~F.col("is_test") if split is not None else F.lit(True)
    seen = df.filter(in_training) if split is not None and fit_on == "train" else df
    indexer = FrequencyIndexer(inputs, outputs, "keep").fit(seen)
    indexed = stage(indexer.transform(df).select(*[column(c) for c in [*carried, *outputs]]), "type-index")
    assembled = assemble(indexed, outputs[:-1])
    scaled = standardize(assembled, "features", FEATURES, assembled.filter(in_training))
    ready = scaled.select(*[column(c) for c in carried], FEATURES, LABEL)
    return ready.withMetadata(LABEL, label_attribute(indexer.labels(label)))


def tree(features: str = FEATURES, label: str = LABEL, **params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxMemoryInMB=512, **params)


def param_grid(estimator: DecisionTreeClassifier, depths: list[int], leaf_sizes: list[int]) -> list[dict]:
    """All pairs of depth and leaf size, depth by depth."""
    return (
        ParamGridBuilder()
        .addGrid(estimator.maxDepth, depths)
        .addGrid(estimator.minInstancesPerNode, leaf_sizes)
        .build()
    )


def _f1_by_depth(model: Model, rows: DataFrame, label: str, depths: list[int]) -> dict[int, float]:
    scored = weighted_f1(counts_by_depth(model, rows, label, depths), ["depth"])
    return {r["depth"]: r["f1"] for r in scored.collect()}


def _f1_by_tree(
    rows: DataFrame, features: str, label: str, steps: list[Step], parallelism: int
) -> list[dict[bool, dict[int, float]]]:
    """For each step the F1 by depth, on the rows it learned from and on the others."""
    counts = counts_by_tree(rows, features, label, steps, lambda run, items: in_threads(run, items, parallelism))
    found: list[dict[bool, dict[int, float]]] = [{True: {}, False: {}} for _ in steps]
    for r in weighted_f1(counts, ["tree", "learned", "depth"]).collect():
        found[r["tree"]][r["learned"]][r["depth"]] = r["f1"]
    return found


def cross_validate(
    df: DataFrame,
    key: str = KEY,
    depths: list[int] = CV_DEPTHS,
    leaf_sizes: list[int] = CV_LEAF_SIZES,
    folds: int = 5,
    parallelism: int = 2,
    seed: int = 1234,
    test: DataFrame | None = None,
    features: str = FEATURES,
    label: str = LABEL,
    fit_best: bool = True,
    whole_rows: int = WHOLE_ROWS,
) -> Tuned:
    """Mean F1 of every parameter set over folds that depend on the key alone.

    In each fold one tree is fitted for each leaf size, to the greatest depth, and cut at the others,
    on more than ``whole_rows`` rows in parts. With ``fit_best`` the best tree is fitted once more on
    all rows, which the driver then holds whole; with ``test`` it is judged on those rows too.
    """
    data = with_folds(df.select(column(key), features, label), [key], folds, seed)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)

    def run(step: tuple[int, int]) -> dict[int, float]:
        fold, leaf = step
        model = tree(features, label, maxDepth=max(depths), minInstancesPerNode=leaf).fit(data.filter(F.col("fold") != fold))
        return _f1_by_depth(model, data.filter(F.col("fold") == fold), label, depths)

    estimator = tree(features, label)
    points = [(m[estimator.maxDepth], m[estimator.minInstancesPerNode]) for m in param_grid(estimator, depths, leaf_sizes)]
    steps = [(fold, leaf) for leaf in leaf_sizes for fold in range(folds)]
    try:
        if data.count() > whole_rows:
            parts = [Step(leaf, depths, F.col("fold") != fold) for fold, leaf in steps]
            scores = {s: f1[False] for s, f1 in zip(steps, _f1_by_tree(data, features, label, parts, parallelism))}
        else:
            scores = dict(zip(steps, in_threads(run, steps, parallelism)))
        rows = [
            (i, float(depth), float(leaf), sum(scores[fold, leaf].get(depth, 0.0) for fold in range(folds)) / folds)
            for i, (depth, leaf) in enumerate(points)
        ]
        _, depth, leaf, _ = max(rows, key=lambda r: (r[3], -r[0]))
        wanted = fit_best or test is not None
        best = tree(features, label, maxDepth=int(depth), minInstancesPerNode=int(leaf)).fit(data) if wanted else None
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(
        rows, "seq int, max_depth double, minInstancesPerNode double, avg_f1 double"
    )
    marked = mark_best(table, "avg_f1", "seq", "bestModel", float(BEST_MARK)).orderBy("seq").drop("seq")
    test_f1 = None if test is None else weighted_f1(prediction_counts(best.transform(test), label)).first()["f1"]
    return Tuned(marked, best, test_f1)


def tune_type(
    df: DataFrame,
    key: str = KEY,
    test_percent: int = 20,
    seed: int = 1234,
    fit_on: str = "all",
    **options,
) -> Tuned:
    """The whole job: features, split, cross-validation on the training rows, F1 on the test rows."""
    ready = type_features(df, key=key, split=(test_percent, seed), fit_on=fit_on)
    train, test = ready.filter(~F.col("is_test")).drop("is_test"), ready.filter("is_test").drop("is_test")
    return cross_validate(train, key, seed=seed, test=test, **options)


def sweep_type(df: DataFrame, key: str = KEY, test_percent: int = 20, seed: int = 1234, **options) -> Tuned:
    """The sweep as a whole job: features, split, F1 of every point of the grid."""
    ready = type_features(df, key=key, split=(test_percent, seed))
    return sweep(ready.filter(~F.col("is_test")), ready.filter("is_test"), **options)


def sweep(
    train: DataFrame,
    test: DataFrame,
    grid: list[tuple[int, int]] = SWEEP_GRID,
    parallelism: int = 2,
    features: str = FEATURES,
    label: str = LABEL,
    whole_rows: int = WHOLE_ROWS,
) -> Tuned:
    """F1 on the training and on the test rows for every (depth, leaf size); the best test F1 is marked.

    One tree is fitted for each leaf size, to its greatest depth, and cut at its other depths, on more
    than ``whole_rows`` training rows in parts.
    """
    by_leaf: dict[int, list[int]] = {}
    for depth, leaf in grid:
        by_leaf.setdefault(leaf, []).append(depth)

    def run(step: tuple[int, list[int]]) -> tuple[dict[int, float], dict[int, float]]:
        leaf, depths = step
        model = tree(features, label, maxDepth=max(depths), minInstancesPerNode=leaf).fit(train)
        return _f1_by_depth(model, train, label, depths), _f1_by_depth(model, test, label, depths)

    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if train.count() > whole_rows:
            both = [df.select(column(features), column(label), F.lit(known).alias("known")) for df, known in ((train, True), (test, False))]
            parts = [Step(leaf, depths, F.col("known")) for leaf, depths in by_leaf.items()]
            found = _f1_by_tree(both[0].unionByName(both[1]), features, label, parts, parallelism)
            scores = {leaf: (f1[True], f1[False]) for leaf, f1 in zip(by_leaf, found)}
        else:
            scores = dict(zip(by_leaf, in_threads(run, list(by_leaf.items()), parallelism)))
    finally:
        train.unpersist()
        test.unpersist()
    rows = [(i, depth, leaf, *(of.get(depth) for of in scores[leaf])) for i, (depth, leaf) in enumerate(grid)]
    table = train.sparkSession.createDataFrame(
        rows,
        "seq int, max_depth int, minInstancesPerNode int, `training f1` double, `testing f1` double",
    )
    marked = mark_best(table, "testing f1", "seq", "Best Model", BEST_MARK)
    return Tuned(marked.orderBy("seq").drop("seq"), None)


def in_threads(run: Callable, steps: list, parallelism: int) -> list:
    """Run Spark jobs side by side, results in the order of the steps."""
    with ThreadPool(min(parallelism, max(len(steps), 1))) as pool:
        return pool.map(run, steps, chunksize=1)
