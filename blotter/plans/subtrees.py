"""Deep trees on many rows, without ever holding a whole tree.

A tree of millions of nodes costs a pass over all rows for every level and batch of nodes, and is held
on the driver. Here Spark's learner grows the top of a tree only; the rows are then exchanged by the
leaf of the top that they reach, and each group goes on by itself with the same rule: Gini, the same
bins, the first of equal splits, minimum rows a leaf. Nodes stay in their task. What comes back are
counts of (depth, label, prediction) for the rows a tree learned from and for the others.

A row is exchanged once for each tree. Rows of a task that reach the same leaf travel as one value, a
few bytes each; of leaves that do not go on only counts do.

Candidate splits are, as in Spark's learner, quantiles of a sample of at least 10,000 rows, or of all
rows if they are fewer; every row is binned by them, learned from and judged.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.plans.depths import tree_leaves, tree_nodes
from blotter.staging import stage

# The functions that run in Python workers are sent along with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
SAMPLE = 10_000
# Rows that a leaf of the top should have at most; the top is two levels deeper than even splits would need.
# A task holds some 100 bytes a row, and a level costs it a third of what one of the top does.
LEAF_ROWS = 500_000
# Rows that a task gathers before it sends them on, and tasks that trees go on in.
_GATHERED, _TASKS = 250_000, 2_000
# Nodes whose histograms a task holds at once.
_NODES = 2_048
_COUNTS = "tree int, learned boolean, depth int, label double, prediction double, n long"


@dataclass(frozen=True)
class Step:
    """A tree to grow: its leaf size, the depths at which it is judged, and which rows it learns from."""

    leaf: int
    depths: list[int]
    learn: Column


def candidate_splits(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the values, all of them if they are few, else close to even shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(found) <= bins:
        return middles
    stride, upto = len(values) / bins, np.cumsum(counts)
    kept, target = [], stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            kept.append(middles[i - 1])
            target += stride
    return np.array(kept)


def binned(rows: DataFrame, features: str, seen: DataFrame, others: list[Column]) -> tuple[DataFrame, int]:
    """The rows with the features as bin numbers, by splits of a sample of ``seen``, and the number of features.

    ``bins`` has them as bytes, ``features`` as the vector that Spark's learner reads.
    """
    n = seen.count()
    sampled = seen if n <= SAMPLE else seen.sample(fraction=SAMPLE / n, seed=42)
    sample = np.array([r[0] for r in sampled.select(vector_to_array(column(features))).collect()], dtype=float)
    splits = [candidate_splits(sample[:, i]) for i in range(sample.shape[1])]
    width = len(splits)

    @F.arrow_udf("bins binary, numbers array<double>")
    def bin_numbers(vectors: pa.Array) -> pa.Array:
        size = len(vectors)
        values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(size, width)
        found = np.stack([np.searchsorted(s, values[:, i]) for i, s in enumerate(splits)], axis=1).astype(np.uint8)
        ends = pa.array(np.arange(size + 1, dtype=np.int32) * width)
        as_bytes = pa.Array.from_buffers(pa.binary(), size, [None, ends.buffers()[1], pa.py_buffer(found.tobytes())])
        return pa.StructArray.from_arrays([as_bytes, pa.ListArray.from_arrays(ends, found.ravel().astype(float))], ["bins", "numbers"])

    told = rows.select(*others, bin_numbers(vector_to_array(column(features))).alias("told"))
    return told.select("*", "told.bins", array_to_vector("told.numbers").alias("features")).drop("told"), width


def _impurity(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    # Class by class as Spark's learner does, so that gains which are equal there are equal here.
    found = np.ones(n.shape)
    for k in range(counts.shape[-1]):
        share = counts[..., k] / n
        found -= share * share
    return found


def _best_splits(bins: np.ndarray, label: np.ndarray, node: np.ndarray, counts: np.ndarray, leaf: int):
    """Per node: the gain, feature and bin of its best split, and the classes left of it."""
    m, classes = counts.shape
    total = counts.sum(axis=1)
    impurity = _impurity(counts, total)
    gain, feature, at = np.full(m, -np.inf), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    left_of = np.zeros_like(counts)
    place = node * (BINS * classes) + label
    every = np.arange(m)
    for f in range(bins.shape[1]):
        cells = np.bincount(place + bins[:, f].astype(np.int64) * classes, minlength=m * BINS * classes)
        left = cells.reshape(m, BINS, classes).cumsum(axis=1)[:, :-1]
        n_left = left.sum(axis=2)
        n_right = total[:, None] - n_left
        fits = (n_left >= leaf) & (n_right >= leaf)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = (
                impurity[:, None]
                - n_left / total[:, None] * _impurity(left, n_left)
                - n_right / total[:, None] * _impurity(counts[:, None] - left, n_right)
            )
        found[~fits] = -np.inf
        best = found.argmax(axis=1)
        better = found[every, best] > gain
        gain[better], feature[better], at[better] = found[every, best][better], f, best[better]
        left_of[better] = left[every, best][better]
    return gain, feature, at, left_of


def grown(
    bins: np.ndarray, label: np.ndarray, learn: np.ndarray, classes: int, leaf: int, levels: int
) -> Iterator[np.ndarray]:
    """What a tree says of every row when cut at level 0, 1, …, ``levels``; it learns from some of the rows."""
    label = label.astype(np.int64)
    counts = np.bincount(label[learn], minlength=classes)[None, :]
    said = np.full(len(label), counts[0].argmax())
    rows, node = np.arange(len(label)), np.zeros(len(label), dtype=np.int64)
    for _ in range(levels):
        yield said
        total = counts.sum(axis=1)
        open_ = (total >= 2 * leaf) & (counts.max(axis=1) < total)
        number = np.cumsum(open_) - 1
        kept = open_[node] if len(node) else np.zeros(0, dtype=bool)
        rows, node, counts = rows[kept], number[node[kept]], counts[open_]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        next_rows, next_node, next_counts, children = [], [], [], 0
        for first in range(0, len(counts), _NODES):
            part = slice(*np.searchsorted(node, [first, first + _NODES]))
            own, at_node, of = rows[part], node[part] - first, counts[first : first + _NODES]
            known = learn[own]
            gain, feature, at, left = _best_splits(bins[own[known]], label[own[known]], at_node[known], of, leaf)
            split = gain > 0
            number = np.cumsum(split) - 1
            kept = split[at_node]
            own, at_node = own[kept], at_node[kept]
            right = bins[own, feature[at_node]] > at[at_node]
            pairs = np.stack([left[split], (of - left)[split]], axis=1).reshape(-1, of.shape[1])
            child = 2 * number[at_node] + right
            said[own] = pairs.argmax(axis=1)[child]
            next_rows.append(own), next_node.append(child + children), next_counts.append(pairs)
            children += len(pairs)
        if not children:
            rows, node, counts = rows[:0], node[:0], counts[:0]
            continue
        rows, node, counts = np.concatenate(next_rows), np.concatenate(next_node), np.concatenate(next_counts)
    yield said


def _tally(tree: int, learn: np.ndarray, label: np.ndarray, said: np.ndarray, classes: int, depths: list[int]) -> list[tuple]:
    cells = np.bincount((learn.astype(np.int64) * classes + label.astype(np.int64)) * classes + said, minlength=2 * classes * classes)
    return [
        (tree, bool(at // classes // classes), d, float(at // classes % classes), float(at % classes), int(cells[at]))
        for at in np.flatnonzero(cells)
        for d in depths
    ]


def _row_type(width: int) -> np.dtype:
    """How a row travels."""
    return np.dtype([("bins", np.uint8, (width,)), ("label", np.int32), ("learn", np.bool_)])


@dataclass(frozen=True)
class _Top:
    """The top of a tree as arrays, by node: the feature and the last bin that go left, both next nodes, and the leaf's number.

    The next node of a leaf is the leaf itself. ``said`` has for each leaf what its path says, ``goes`` whether it goes on.
    """

    feature: np.ndarray
    last_left: np.ndarray
    following: np.ndarray
    leaf: np.ndarray
    levels: int
    said: list[list[float]]
    goes: list[bool]

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches."""
        node, every = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(self.levels):
            node = self.following[node, (bins[every, self.feature[node]] > self.last_left[node]).astype(np.int64)]
        return self.leaf[node]


def _top_of(nodes: dict[int, Row], deepest: int) -> _Top:
    feature, last_left, leaf = np.zeros(len(nodes), np.int64), np.zeros(len(nodes)), np.zeros(len(nodes), np.uint16)
    following = np.repeat(np.arange(len(nodes))[:, None], 2, axis=1)
    for number, n in nodes.items():
        if n["leftChild"] >= 0:
            feature[number], last_left[number] = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            following[number] = n["leftChild"], n["rightChild"]
    leaves = tree_leaves(nodes)
    leaf[[number for number, _, _ in leaves]] = np.arange(len(leaves))
    said = [path for _, path, _ in leaves]
    # A leaf goes on unless it is pure or as deep as the tree is to be.
    goes = [impurity > 0 and len(path) - 1 < deepest for _, path, impurity in leaves]
    return _Top(feature, last_left, following, leaf, max(map(len, said)) - 1, said, goes)


def _sent(tops: list[_Top], width: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each tree and leaf of its top the rows that reach it, or where the tree does not go on their counts."""

    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = np.zeros(len(table), dtype=_row_type(width))
        together = table["bins"].cast(pa.binary(width)).combine_chunks()
        bins = np.frombuffer(together.buffers()[1], np.uint8, len(rows) * width, together.offset * width).reshape(len(rows), width)
        rows["bins"], rows["label"] = bins, table["label"].to_numpy()
        for number, top in enumerate(tops):
            rows["learn"] = table[f"learn_{number}"].to_numpy()
            leaf = top.reached(bins)
            ordered = rows[np.argsort(leaf, kind="stable")]
            met, counts = np.unique(leaf, return_counts=True)
            groups = np.split(ordered, np.cumsum(counts)[:-1])
            values = [g.tobytes() if top.goes[at] else _label_counts(g, classes).tobytes() for at, g in zip(met, groups)]
            yield pa.RecordBatch.from_pydict(
                {"tree": pa.array([number] * len(met), pa.int32()), "leaf": pa.array(met, pa.int32()), "rows": pa.array(values, pa.binary())}
            )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= _GATHERED:
                yield from packed(waiting)
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield from packed(waiting)

    return send


def _label_counts(rows: np.ndarray, classes: int) -> np.ndarray:
    """Rows by whether they were learned from and label."""
    return np.bincount(rows["learn"] * classes + rows["label"].astype(np.int64), minlength=2 * classes)


def counts_by_tree(
    rows: DataFrame,
    features: str,
    label: str,
    steps: list[Step],
    fit_each: Callable[[Callable, list], list],
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows per (tree, learned, depth, label, prediction); trees are numbered as the steps.

    ``fit_each`` applies a function to every item of a list, side by side or not.
    """
    any_learns = rows.filter(reduce(Column.__or__, [s.learn for s in steps]))
    flags = [s.learn.alias(f"learn_{i}") for i, s in enumerate(steps)]
    table, width = binned(rows, features, any_learns, [column(label).alias("label"), *flags])
    data = stage(table, "binned")
    n, greatest = data.agg(F.count(F.lit(1)), F.max("label")).first()
    classes = int(greatest) + 1
    # Leaves of a top are numbered by 16 bits.
    levels = min(16, max(1, ceil(log2(max(1.0, n / leaf_rows))) + 2))

    def fit(step: tuple[int, Step]) -> _Top:
        number, s = step
        learner = DecisionTreeClassifier(
            featuresCol="features", labelCol="label", maxBins=BINS, maxMemoryInMB=512,
            maxDepth=min(levels, max(s.depths)), minInstancesPerNode=s.leaf,
        )
        model = learner.fit(data.filter(f"learn_{number}").select("label", "features"))
        return _top_of(tree_nodes(data.sparkSession, model), max(s.depths))

    tops = fit_each(fit, list(enumerate(steps)))
    shapes = [(s.leaf, list(s.depths)) for s in steps]

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        number, at = int(key[0]), int(key[1])
        leaf, depths = shapes[number]
        top = tops[number]
        above = top.said[at]
        level = len(above) - 1
        found: list[tuple] = []
        if top.goes[at]:
            own = np.frombuffer(b"".join(group["rows"]), dtype=_row_type(width))
            bins, label, learn = own["bins"], own["label"], own["learn"]
            for d in depths:
                if d < level:
                    found += _tally(number, learn, label, np.full(len(label), int(above[d])), classes, [d])
            for down, said in enumerate(grown(bins, label, learn, classes, leaf, max(depths) - level)):
                if level + down in depths:
                    found += _tally(number, learn, label, said, classes, [level + down])
        else:
            counts = sum(np.frombuffer(r, dtype=np.int64) for r in group["rows"])
            found = [
                (number, bool(i // classes), d, float(i % classes), float(above[min(d, level)]), int(counts[i]))
                for i in np.flatnonzero(counts)
                for d in depths
            ]
        return pd.DataFrame(found, columns=["tree", "learned", "depth", "label", "prediction", "n"])

    sent = data.drop("features").mapInArrow(_sent(tops, width, classes), "tree int, leaf int, rows binary")
    # Groups are small in bytes and long in work: so many tasks that none has many.
    spread = sent.repartition(min(_TASKS, sum(len(t.said) for t in tops)), "tree", "leaf")
    counted = spread.groupBy("tree", "leaf").applyInPandas(finish, _COUNTS)
    return counted.groupBy("tree", "learned", "depth", "label", "prediction").agg(F.sum("n").alias("n"))
