"""Forests of deep trees on all rows, without ever holding a whole tree.

A forest whose trees grow until their leaves are pure has about as many nodes as rows, a hundred times.
Here the driver holds the tops of the trees only. They are grown level by level from histograms of all
training rows, until no leaf has too many of them; then rows are exchanged by the leaf they reach, and
each group goes on by itself with the same rule: a bootstrap of the rows for each tree, features drawn
anew for each node, Gini, the same bins. Test rows travel along and come back as votes, so nodes stay in
their task. Trees are grown in rounds that exchange a bounded number of rows each.

Bins are parted by thresholds close to even shares of all training rows. How often a tree draws a row
follows from the row's number in the staged table and the tree's alone, so a repeated task draws the same.
As in Spark's learner, leaves next to each other that say the same are one leaf, and a leaf votes with the
shares of its classes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.staging import shuffles_deleted, stage

# The functions that run in Python workers are sent along with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Training rows, drawn ones counted as often as they are drawn, that a group goes on with at most.
LEAF_ROWS = 1_000_000
# Copies of rows (rows times trees) that a round of trees exchanges, or one tree if that has more.
ROUND_ROWS = 100_000_000
# Rows that a task gathers before it sends them on, and tasks that trees go on in at most.
_GATHERED, _TASKS = 250_000, 2_000
# Values of a feature that a gathered part of the rows tells of itself; each stands for a like number of rows.
_POINTS = 4_096
# Rows that are led down a top at once.
_PIECE = 32_768
# Cells of histograms that a task holds at once.
_CELLS = 4_000_000
# Votes are added up by blocks of so many bits of the rows' numbers.
_BLOCK = 16
_VOTE = np.dtype([("at", np.uint16), ("class", np.int32), ("share", np.float64)])
# How often a row is drawn, Poisson with mean 1, by 16 random bits.
_DRAWN = np.searchsorted(np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row, by the row's number."""
    z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.random.SeedSequence([seed, tree]).generate_state(1, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _DRAWN[(z ^ (z >> np.uint64(31))) >> np.uint64(48)]


# --- bins --------------------------------------------------------------------


def even_splits(found: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between sorted values that stand for so many rows: all of them if they are few, else close to even shares."""
    middles = (found[:-1] + found[1:]) / 2
    if len(found) <= bins:
        return middles
    upto = np.cumsum(counts)
    stride, kept = upto[-1] / bins, []
    target = stride
    for i, (before, after) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
        if abs(before - target) < abs(after - target):
            kept.append(i)
            target += stride
    return middles[kept]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= _GATHERED:
            yield pa.Table.from_batches(waiting)
            waiting = []
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of the rows and feature: its values and how many rows have them, or points that stand for even shares."""
    for table in _gathered(batches):
        n = len(table)
        rows = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["x"].chunks]).reshape(n, -1)
        told = []
        for x in rows.T:
            found, counts = np.unique(x, return_counts=True)
            if len(found) > _POINTS:
                upto = np.cumsum(counts)
                last = np.unique(np.searchsorted(upto, np.arange(1, _POINTS + 1) * (n / _POINTS)).clip(max=len(found) - 1))
                found, counts = found[last], np.diff(upto[last], prepend=0)
            told.append((found.astype(float).tobytes(), counts.astype(np.int64).tobytes()))
        values, counts = zip(*told)
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(range(len(told)), pa.int32()), "found": pa.array(values, pa.binary()), "counts": pa.array(counts, pa.binary())}
        )


def splits_of_all(seen: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """The thresholds of every feature, from all rows of ``seen``."""

    def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(parts["found"]), np.float64)
        found, at = np.unique(values, return_inverse=True)
        counts = np.bincount(at, weights=np.frombuffer(b"".join(parts["counts"]), np.int64))
        return pd.DataFrame({"feature": [key[0]], "splits": [even_splits(found, counts, bins).tolist()]})

    parts = seen.select(vector_to_array(column(features)).alias("x")).mapInArrow(_summarised, "feature int, found binary, counts binary")
    told = parts.groupBy("feature").applyInPandas(merged, "feature int, splits array<double>").collect()
    return [np.array(r["splits"], dtype=float) for r in sorted(told, key=lambda r: r["feature"])]


def _binned(features: str, splits: list[np.ndarray]) -> Column:
    width, kind = len(splits), _bin_type(splits)

    @F.arrow_udf("binary")
    def numbers(vectors: pa.Array) -> pa.Array:
        size = len(vectors)
        values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(size, width)
        found = np.stack([np.searchsorted(s, values[:, i]) for i, s in enumerate(splits)], axis=1).astype(kind)
        ends = pa.array(np.arange(size + 1, dtype=np.int32) * (width * kind.itemsize))
        return pa.Array.from_buffers(pa.binary(), size, [None, ends.buffers()[1], pa.py_buffer(found.tobytes())])

    return numbers(vector_to_array(column(features)))


def _bin_type(splits: list[np.ndarray]) -> np.dtype:
    return np.dtype(np.uint8 if max(map(len, splits)) < 256 else np.uint16)


# --- one group of rows -------------------------------------------------------


def _gains(left: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a split gains in rows times Gini, from the classes left of it; none if a side has no rows."""
    n, n_left = counts.sum(axis=-1), left.sum(axis=-1)
    right = counts - left
    with np.errstate(invalid="ignore", divide="ignore"):
        found = (left * left).sum(axis=-1) / n_left + (right * right).sum(axis=-1) / (n - n_left)
    found -= (counts * counts).sum(axis=-1) / n
    return np.where((n_left > 0) & (n_left < n), found, -np.inf)


def _keep_better(best: tuple, at: np.ndarray, gain: np.ndarray, feature: np.ndarray, last: np.ndarray) -> None:
    better = gain > best[0][at]
    at = at[better]
    best[0][at], best[1][at], best[2][at] = gain[better], feature[better], last[better]


def _split_large(best: tuple, nodes: np.ndarray, starts: np.ndarray, rows: tuple, counts: np.ndarray, subset: np.ndarray, size: int) -> None:
    """The best splits of nodes of many rows, from histograms. ``starts`` has where the rows of a node begin."""
    bins, label, weight = rows
    classes = counts.shape[1]
    step = max(1, _CELLS // (size * classes))
    for first in range(0, len(nodes), step):
        own = nodes[first : first + step]
        lengths = starts[own + 1] - starts[own]
        local = np.repeat(np.arange(len(own)), lengths)
        at = np.arange(len(local)) + np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        place, w, of = local * (size * classes) + label[at], weight[at], counts[own].astype(float)
        for j in range(subset.shape[1]):
            feature = subset[own, j]
            cell = place + bins[at, feature[local]].astype(np.int64) * classes
            cells = np.bincount(cell, weights=w, minlength=len(own) * size * classes).reshape(len(own), size, classes)
            found = _gains(cells.cumsum(axis=1)[:, :-1], of[:, None])
            last = found.argmax(axis=1)
            _keep_better(best, own, found[np.arange(len(own)), last], feature, last)


def _split_small(best: tuple, nodes: np.ndarray, starts: np.ndarray, rows: tuple, counts: np.ndarray, subset: np.ndarray, size: int) -> None:
    """The best splits of nodes of few rows, from the rows in the order of their bins: the work does not grow with bins or classes."""
    bins, label, weight = rows
    classes = counts.shape[1]
    lengths = starts[nodes + 1] - starts[nodes]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    local = np.repeat(np.arange(len(nodes)), lengths)
    at = np.arange(len(local)) + np.repeat(starts[nodes] - begin, lengths)
    n, bits = len(at), int(classes - 1).bit_length()
    of = counts[nodes]
    total, squares = of.sum(axis=1), (of.astype(float) ** 2).sum(axis=1)
    drawn, place, low = label[at] << 8 | weight[at], local * size, (1 << bits + 8) - 1
    ends = begin + lengths - 1
    of, every = of.ravel(), local * classes
    for j in range(subset.shape[1]):
        feature = subset[nodes, j]
        key = np.sort((place + bins[at, feature[local]]) << bits + 8 | drawn)
        cell, w, kind = key >> bits + 8, key & 255, (key & low) >> 8
        ending = np.empty(n, dtype=bool)
        np.not_equal(cell[1:], cell[:-1], out=ending[:-1])
        ending[ends] = False
        found = np.full(n, -np.inf)
        if not ending.any():
            continue
        upto = np.cumsum(w)
        n_left = upto - np.repeat(upto[begin] - w[begin], lengths)
        if classes == 2:
            ones = w * kind
            upto = np.cumsum(ones)
            ones = (upto - np.repeat(upto[begin] - ones[begin], lengths))[ending]
            here = local[ending]
            n_left = n_left[ending]
            left = np.stack([n_left - ones, ones], axis=1)
            found[ending] = _gains(left.astype(float), counts[nodes][here].astype(float))
        else:
            # Rows of the same class before a row in its node: what the squares of the classes left of it grow by.
            group = np.sort((every + kind) << 32 | np.arange(n))
            order = group & 0xFFFFFFFF
            group >>= 32
            own = w[order]
            upto = np.cumsum(own) - own
            opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            before = upto - np.repeat(upto[opens], np.diff(np.append(opens, n)))
            grows = np.empty(n, dtype=np.int64)
            grows[order] = own * (2 * before + own)
            both = np.cumsum(grows)
            with_all = w * of[every + kind]
            crossed = np.cumsum(with_all)
            both = (both - np.repeat(both[begin] - grows[begin], lengths))[ending]
            crossed = (crossed - np.repeat(crossed[begin] - with_all[begin], lengths))[ending]
            here, n_left = local[ending], n_left[ending]
            found[ending] = both / n_left + (squares[here] - 2 * crossed + both) / (total[here] - n_left) - squares[here] / total[here]
        most = np.maximum.reduceat(found, begin)
        at_most = np.flatnonzero((found == np.repeat(most, lengths)) & ending)[::-1]
        first = np.zeros(len(nodes), dtype=np.int64)
        first[local[at_most]] = at_most
        _keep_better(best, nodes, most, feature, cell[first] % size)


def best_splits(starts: np.ndarray, rows: tuple, counts: np.ndarray, subset: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the gain, feature and last bin on the left of the best split by one of the node's features."""
    m, classes = counts.shape
    best = np.full(m, -np.inf), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    large = np.diff(starts) * 4 >= size * classes
    if large.any():
        _split_large(best, np.flatnonzero(large), starts, rows, counts, subset, size)
    if not large.all():
        _split_small(best, np.flatnonzero(~large), starts, rows, counts, subset, size)
    return best


def drawn_features(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """For each node the features that it may be split by, as many as the root of their number."""
    k = ceil(sqrt(width))
    return rng.random((nodes, width)).argpartition(k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (nodes, 1))


def gains_enough(gain: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a split gains more than what adding up may be wrong by."""
    return gain > 1e-14 * n


def grown(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, test: np.ndarray, classes: int, levels: int, rng: np.random.Generator, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """A tree of at most so many levels: for each test row the node that answers, and rows by class of every node."""
    label, weight = label.astype(np.int64), weight.astype(np.int64)
    counts = np.bincount(label, weights=weight, minlength=classes).astype(np.int64)[None, :]
    starts = np.array([0, len(label)])
    judged, node = np.arange(len(test)), np.zeros(len(test), dtype=np.int64)
    reached = np.zeros(len(test), dtype=np.int64)
    # Per level: rows by class, and where each node's left child is in the next level, -1 for a leaf.
    of_level, children, first_of = [counts], [], 0
    for _ in range(levels):
        following = np.full(len(counts), -1, dtype=np.int64)
        children.append(following)
        open_ = np.flatnonzero(counts.max(axis=1) < counts.sum(axis=1))
        if not len(open_):
            break
        kept = np.zeros(len(counts), dtype=bool)
        kept[open_] = True
        lengths = np.diff(starts)
        if not kept.all():
            bins, label, weight = _taken(np.flatnonzero(np.repeat(kept, lengths)), bins, label, weight)
        lengths = lengths[open_]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        gain, feature, last = best_splits(starts, (bins, label, weight), counts[open_], drawn_features(rng, len(open_), bins.shape[1]), size)
        split = gains_enough(gain, counts[open_].sum(axis=1))
        if not split.any():
            break
        if not split.all():
            bins, label, weight = _taken(np.flatnonzero(np.repeat(split, lengths)), bins, label, weight)
            lengths = lengths[split]
        feature, last, parents = feature[split], last[split], open_[split]
        following[parents] = 2 * np.arange(len(parents))
        # Test rows go down, those in a leaf stay.
        stay = following[node] >= 0
        judged, node = judged[stay], node[stay]
        side = np.empty(len(counts), dtype=np.int64)
        side[parents] = np.arange(len(parents))
        on = side[node]
        node = 2 * on + (test[judged, feature[on]] > last[on])
        first_of += len(counts)
        reached[judged] = first_of + node
        # Training rows are put in the order of their children, otherwise as they were.
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        own = np.repeat(np.arange(len(lengths)), lengths)
        right = bins[np.arange(len(own)), feature[own]] > last[own]
        lefts = np.cumsum(~right) - ~right
        lefts -= np.repeat(lefts[begin], lengths)
        to_left = np.add.reduceat((~right).astype(np.int64), begin)
        within = np.arange(len(own)) - np.repeat(begin, lengths)
        to = np.repeat(begin, lengths) + np.where(right, np.repeat(to_left, lengths) + within - lefts, lefts)
        order = np.empty(len(own), dtype=np.int64)
        order[to] = np.arange(len(own))
        child = 2 * own + right
        counts = np.bincount(child * classes + label, weights=weight, minlength=2 * len(lengths) * classes)
        counts = counts.reshape(-1, classes).astype(np.int64)
        bins, label, weight = _taken(order, bins, label, weight)
        starts = np.concatenate([[0], np.cumsum(np.stack([to_left, lengths - to_left], axis=1).ravel())])
        of_level.append(counts)
    return _joined(of_level, children)[reached], np.concatenate(of_level)


def _taken(at: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
    return [r.take(at, axis=0) for r in rows]


def _joined(of_level: list[np.ndarray], children: list[np.ndarray]) -> np.ndarray:
    """For every node the one that answers for it: leaves under one parent that say the same are one leaf."""
    said = [c.argmax(axis=1) for c in of_level]
    leaf = [np.ones(len(c), dtype=bool) for c in of_level]
    up = [np.full(len(c), -1, dtype=np.int64) for c in of_level]
    for at in reversed(range(len(of_level) - 1)):
        inner = np.flatnonzero(children[at] >= 0)
        left = children[at][inner]
        right = left + 1
        same = leaf[at + 1][left] & leaf[at + 1][right] & (said[at + 1][left] == said[at + 1][right])
        leaf[at][inner] = same
        up[at + 1][left[same]] = up[at + 1][right[same]] = inner[same]
    answers = [np.arange(len(of_level[0]))]
    first = len(of_level[0])
    for joins in up[1:]:
        answers.append(np.where(joins >= 0, answers[-1][joins], first + np.arange(len(joins))))
        first += len(joins)
    return np.concatenate(answers)


# --- tops of trees -----------------------------------------------------------


@dataclass
class Top:
    """The top of a tree, by node: feature and last bin that go left, left child (the right one follows it), depth and classes.

    A leaf is its own child. ``goes`` says whether a leaf goes on in a group; classes of a root that does are not known here.
    """

    number: int
    classes: int
    feature: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    counts: list[np.ndarray] = field(default_factory=lambda: [None])
    goes: list[bool] = field(default_factory=lambda: [True])

    def split(self, node: int, feature: int, last: int, sides: list[np.ndarray]) -> list[int]:
        self.feature[node], self.last[node], self.left[node], self.goes[node] = feature, last, len(self.left), False
        for counts in sides:
            self.feature.append(0), self.last.append(0), self.left.append(-1)
            self.depth.append(self.depth[node] + 1), self.counts.append(counts), self.goes.append(True)
        return [len(self.left) - 2, len(self.left) - 1]

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches."""
        leaf = np.array(self.left) < 0
        feature, following = np.array(self.feature), np.where(leaf, np.arange(len(leaf)), self.left)
        last = np.where(leaf, np.iinfo(np.int64).max, self.last)
        node = np.zeros(len(bins), dtype=np.int64)
        if len(leaf) == 1:
            return node
        values, width = bins.ravel(), bins.shape[1]
        # In pieces that stay in the processor's cache.
        for start in range(0, len(bins), _PIECE):
            at = node[start : start + _PIECE]
            first = np.arange(start, start + len(at)) * width
            for _ in range(max(self.depth)):
                right = values.take(first + feature.take(at)) > last.take(at)
                at[:] = following.take(at) + right
        return node


@dataclass(frozen=True)
class _Rows:
    """How rows travel, and what all steps need to know of them."""

    width: int
    kind: np.dtype
    classes: int
    size: int
    seed: int

    @property
    def learned(self) -> np.dtype:
        label = np.uint8 if self.classes <= 256 else np.int32
        return np.dtype([("bins", self.kind, (self.width,)), ("label", label), ("weight", np.uint8)])

    @property
    def judged(self) -> np.dtype:
        return np.dtype([("bins", self.kind, (self.width,)), ("row", np.int64)])

    def bins(self, table: pa.Table) -> np.ndarray:
        parts = []
        for c in (c for c in table["bins"].chunks if len(c)):
            ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        return np.concatenate(parts).view(self.kind).reshape(len(table), self.width)


def _histograms(tops: list[Top], open_: dict[int, dict[int, np.ndarray]], rows: _Rows) -> Callable:
    """For each tree and open node rows by drawn feature, bin and class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for table in _gathered(batches):
            bins, label, row = rows.bins(table), table["label"].to_numpy().astype(np.int64), table["row"].to_numpy()
            for top in tops:
                nodes = open_.get(top.number)
                if not nodes:
                    continue
                subset = np.array(list(nodes.values()))
                m, k = subset.shape
                slot = np.full(len(top.left), -1, dtype=np.int64)
                slot[list(nodes)] = np.arange(m)
                total = found.setdefault(top.number, np.zeros((k, m * rows.size * rows.classes)))
                step = max(_PIECE, total.shape[1])
                for start in range(0, len(row), step):
                    weight = draws(row[start : start + step], top.number, rows.seed)
                    drawn = np.flatnonzero(weight)
                    own = bins[start : start + step].take(drawn, axis=0)
                    at = slot.take(top.reached(own))
                    used = np.flatnonzero(at >= 0)
                    at, drawn = at.take(used), drawn.take(used)
                    w, place = weight.take(drawn), at * (rows.size * rows.classes) + label[start : start + step].take(drawn)
                    values, first = own.ravel(), used * rows.width
                    for j in range(k):
                        cell = place + values.take(first + subset[:, j].take(at)) * np.int64(rows.classes)
                        total[j] += np.bincount(cell, weights=w, minlength=total.shape[1])
        for number, total in found.items():
            nodes = open_[number]
            by_node = total.astype(np.int64).reshape(len(total), len(nodes), -1).swapaxes(0, 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": pa.array([number] * len(nodes), pa.int32()),
                    "node": pa.array(list(nodes), pa.int32()),
                    "cells": pa.array([cells.tobytes() for cells in by_node], pa.binary()),
                }
            )

    return count


def _best_of_node(open_: dict[int, dict[int, np.ndarray]], rows: _Rows) -> Callable:
    def best(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        subset = open_[int(key[0])][int(key[1])]
        cells = sum(np.frombuffer(c, np.int64) for c in parts["cells"]).reshape(len(subset), rows.size, rows.classes)
        counts = cells[0].sum(axis=0)
        left = cells.cumsum(axis=1)[:, :-1]
        found = _gains(left.astype(float), counts.astype(float))
        j, last = np.unravel_index(found.argmax(), found.shape) if found.size else (0, 0)
        gain = float(found[j, last]) if found.size else float("-inf")
        sides = [left[j, last], counts - left[j, last]] if found.size else [counts, counts]
        told = {"tree": key[0], "node": key[1], "gain": gain, "feature": int(subset[j]), "last": int(last), "left": sides[0].tolist(), "right": sides[1].tolist()}
        return pd.DataFrame([told])

    return best


def _grow_tops(learned: DataFrame, tops: list[Top], rows: _Rows, levels: int, leaf_rows: int, n: int) -> None:
    """Split the nodes of the tops that have too many rows, level by level."""
    waiting = {top.number: [0] for top in tops} if n > leaf_rows and levels > 0 else {}
    by_number = {top.number: top for top in tops}
    while waiting:
        open_ = {
            number: {v: drawn_features(np.random.default_rng([rows.seed, number, v, 0]), 1, rows.width)[0] for v in nodes}
            for number, nodes in waiting.items()
        }
        cells = learned.mapInArrow(_histograms(tops, open_, rows), "tree int, node int, cells binary")
        best = cells.groupBy("tree", "node").applyInPandas(
            _best_of_node(open_, rows), "tree int, node int, gain double, feature int, last int, left array<long>, right array<long>"
        )
        waiting = {}
        for r in sorted(best.collect(), key=lambda r: (r["tree"], r["node"])):
            top, sides = by_number[r["tree"]], [np.array(r["left"]), np.array(r["right"])]
            if top.counts[r["node"]] is None:
                top.counts[r["node"]] = sides[0] + sides[1]
            whole = top.counts[r["node"]]
            if whole.max() == whole.sum() or not gains_enough(r["gain"], whole.sum()):
                top.goes[r["node"]] = False
                continue
            for v in top.split(r["node"], r["feature"], r["last"], sides):
                counts = top.counts[v]
                top.goes[v] = bool(counts.max() < counts.sum()) and top.depth[v] < levels
                if top.goes[v] and counts.sum() > leaf_rows:
                    waiting.setdefault(top.number, []).append(v)


# --- votes -------------------------------------------------------------------


def _sent(tops: list[Top], rows: _Rows) -> Callable:
    """For each tree and leaf of its top the rows that reach it; of leaves that do not go on test rows only, in pieces."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            bins, label, row = rows.bins(table), table["label"].to_numpy(), table["row"].to_numpy()
            is_test = table["is_test"].to_numpy(zero_copy_only=False).astype(bool)
            tests = np.zeros(int(is_test.sum()), dtype=rows.judged)
            tests["bins"], tests["row"] = bins[is_test], row[is_test]
            others = np.zeros(len(bins) - len(tests), dtype=rows.learned)
            others["bins"], others["label"] = bins[~is_test], label[~is_test]
            other_row = row[~is_test]
            for top in tops:
                others["weight"] = draws(other_row, top.number, rows.seed)
                of_others, of_tests = top.reached(others["bins"]), top.reached(tests["bins"])
                goes = np.array(top.goes)
                drawn = others["weight"] > 0
                if not goes.all():
                    drawn &= goes[of_others]
                groups = [_by_leaf(others[drawn], of_others[drawn]), _by_leaf(tests, of_tests)]
                leaves = sorted(set(groups[0]) | set(groups[1]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([top.number] * len(leaves), pa.int32()),
                        "leaf": pa.array(leaves, pa.int32()),
                        "piece": pa.array([0 if top.goes[v] else int(row[0]) for v in leaves], pa.int64()),
                        **{c: pa.array([g.get(v, b"") for v in leaves], pa.binary()) for c, g in zip(("learned", "judged"), groups)},
                    }
                )

    return send


def _by_leaf(rows: np.ndarray, leaf: np.ndarray) -> dict[int, bytes]:
    if not len(rows):
        return {}
    # Small numbers are sorted by counting.
    leaf = leaf.astype(np.uint16) if leaf.max() < 1 << 16 else leaf
    order = np.argsort(leaf, kind="stable")
    met, first = np.unique(leaf[order], return_index=True)
    return {int(v): part.tobytes() for v, part in zip(met, np.split(rows.take(order), first[1:]))}


def _finished(tops: dict[int, Top], rows: _Rows, levels: int) -> Callable:
    """The votes of a leaf's test rows, by block of their numbers."""

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        top, leaf = tops[int(key[0])], int(key[1])
        tests = np.frombuffer(b"".join(group["judged"]), dtype=rows.judged)
        if top.goes[leaf]:
            own = np.frombuffer(b"".join(group["learned"]), dtype=rows.learned)
            # The tree follows from the rows and these numbers, not from the order in which rows arrive.
            rng = np.random.default_rng([rows.seed, top.number, leaf, 1])
            answers, counts = grown(
                np.ascontiguousarray(own["bins"]), own["label"], own["weight"], np.ascontiguousarray(tests["bins"]),
                rows.classes, levels - top.depth[leaf], rng, rows.size,
            )
        else:
            answers, counts = np.zeros(len(tests), dtype=np.int64), top.counts[leaf][None, :]
        found = []
        order = np.argsort(tests["row"] >> _BLOCK, kind="stable")
        number, answers = tests["row"][order], answers[order]
        blocks, first = np.unique(number >> _BLOCK, return_index=True)
        for block, at in zip(blocks, np.split(np.arange(len(number)), first[1:])):
            own = counts[answers[at]]
            voter, kind = np.nonzero(own)
            votes = np.zeros(len(voter), dtype=_VOTE)
            votes["at"], votes["class"] = number[at][voter] & ((1 << _BLOCK) - 1), kind
            votes["share"] = own[voter, kind] / own.sum(axis=1)[voter]
            found.append((int(key[0]), int(block), votes.tobytes()))
        return pd.DataFrame(found, columns=["tree", "block", "votes"])

    return finish


def _elected(classes: int) -> Callable:
    """Votes of all trees, added up in the order of the trees."""

    def elect(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        votes = np.frombuffer(b"".join(group.sort_values("tree", kind="stable")["votes"]), dtype=_VOTE)
        at, place = np.unique(votes["at"], return_inverse=True)
        total = np.bincount(place * classes + votes["class"], weights=votes["share"], minlength=len(at) * classes).reshape(-1, classes)
        score = total[:, 1] / total.sum(axis=1) if classes > 1 else np.zeros(len(at))
        return pd.DataFrame({"__at": (int(key[0]) << _BLOCK) + at.astype(np.int64), "prediction": total.argmax(axis=1).astype(float), "score": score})

    return elect


def with_forest_votes(
    rows: DataFrame,
    features: str,
    label: str,
    learn: Column,
    judge: Column,
    classes: int,
    trees: int,
    depth: int,
    seed: int,
    bins: int,
    leaf_rows: int = LEAF_ROWS,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """The rows of ``judge`` with ``prediction`` and ``score``, the share of votes for the second class, by a forest of the rows of ``learn``.

    ``rows`` and what ``learn`` and ``judge`` say of them must be the same whenever they are read. No row may be in both.
    """
    spark = rows.sparkSession
    splits = splits_of_all(rows.filter(learn), features, bins)
    others = [c for c in rows.columns if c not in (features, label)]
    table = stage(
        rows.filter(learn | judge).select(
            *[column(c) for c in others], column(label), judge.alias("__is_test"),
            _binned(features, splits).alias("__bins"), F.monotonically_increasing_id().alias("__row"),
        ),
        "binned",
    )
    data = table.select(F.col("__bins").alias("bins"), column(label).cast("int").alias("label"), F.col("__is_test").alias("is_test"), F.col("__row").alias("row"))
    n, n_learned = data.agg(F.count(F.lit(1)), F.count_if(~F.col("is_test"))).first()
    shape = _Rows(len(splits), _bin_type(splits), max(1, classes), max(map(len, splits)) + 1, seed)
    size = max(1, min(trees, round_rows // max(1, n)))
    voted = None
    for first in range(0, trees, size):
        tops = [Top(number, shape.classes) for number in range(first, min(first + size, trees))]
        with shuffles_deleted(spark):
            _grow_tops(data.filter(~F.col("is_test")), tops, shape, depth, leaf_rows, n_learned)
            sent = data.mapInArrow(_sent(tops, shape), "tree int, leaf int, piece long, learned binary, judged binary")
            groups = sum(v < 0 for top in tops for v in top.left)
            # Groups are small in bytes and long in work: so many tasks that none has many.
            spread = sent.repartition(min(_TASKS, 4 * groups), "tree", "leaf", "piece").groupBy("tree", "leaf", "piece")
            votes = spread.applyInPandas(_finished({t.number: t for t in tops}, shape, depth), "tree int, block long, votes binary")
            part = stage(votes, "votes")
        voted = part if voted is None else voted.unionByName(part)
    elected = voted.groupBy("block").applyInPandas(_elected(shape.classes), "__at long, prediction double, score double")
    known = table.filter("__is_test").select("__row", *[column(c) for c in others], column(label))
    found = known.join(elected, F.col("__row") == F.col("__at"))
    return found.select(*[column(c) for c in others], column(label), "prediction", "score")
