"""Means, deviations, correlations and components of a table from one pass over it.

One row of aggregates (count, means, covariances), merged from one of every task, has all that scaling, correlations and principal
components need; they follow on the driver from a matrix as wide as the columns are many. Rows that
lack one of the columns do not count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions.names import column


_PART = "n long, means array<double>, covariances array<array<double>>, least array<double>, greatest array<double>"


def _task_moments(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task tells of its rows: one row, batch by batch from deviations of the batch's own means."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, means, within = 0, np.zeros(width), np.zeros((width, width))
        least, greatest = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            own = x.mean(axis=0)
            apart, centred = own - means, x - own
            within += centred.T @ centred + np.outer(apart, apart) * (n * m / (n + m))
            means = means + apart * (m / (n + m))
            n += m
            least, greatest = np.minimum(least, x.min(axis=0)), np.maximum(greatest, x.max(axis=0))
        if n:
            found = {"n": [n], "means": [means.tolist()], "covariances": [(within / n).tolist()]}
            yield pa.RecordBatch.from_pydict({**found, "least": [least.tolist()], "greatest": [greatest.tolist()]})

    return told


@dataclass(frozen=True)
class Moments:
    """Of the named columns: rows, means, population covariances, least and greatest values."""

    names: list[str]
    n: int
    means: np.ndarray
    covariances: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    def __post_init__(self):
        # Rounding may leave a constant column a trace of variance.
        constant = self.least == self.greatest
        self.covariances[constant, :] = self.covariances[:, constant] = 0.0

    @staticmethod
    def fit(df: DataFrame, names: list[str]) -> Moments:
        complete = df.filter(reduce(Column.__and__, [column(c).isNotNull() for c in names]))
        numbers = complete.select(*[column(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
        # One row for each task: an aggregate for every pair of columns makes code that is never compiled.
        parts = [
            Moments(list(names), r["n"], *(np.array(r[f]) for f in ("means", "covariances", "least", "greatest")))
            for r in numbers.mapInArrow(_task_moments(len(names)), _PART).collect()
        ]
        if not parts:
            raise ValueError("no rows to fit on")
        return reduce(Moments.merged, parts)

    def merged(self, other: Moments) -> Moments:
        """Of the rows of both, without reading them again."""
        n = self.n + other.n
        apart = other.means - self.means
        within = self.n * self.covariances + other.n * other.covariances
        between = np.outer(apart, apart) * self.n * other.n / n
        least, greatest = np.minimum(self.least, other.least), np.maximum(self.greatest, other.greatest)
        return Moments(self.names, n, self.means + apart * other.n / n, (within + between) / n, least, greatest)

    @property
    def deviations(self) -> np.ndarray:
        """Sample standard deviations; nan for a single row."""
        return np.sqrt(np.diag(self.covariances) * self.n / (self.n - 1)) if self.n > 1 else np.full(len(self.names), np.nan)

    @property
    def correlations(self) -> np.ndarray:
        """Of every two columns; nan where one is constant."""
        size = np.sqrt(np.diag(self.covariances))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.covariances / np.outer(size, size)

    def described(self, spark: SparkSession) -> DataFrame:
        """Mean and sample standard deviation, a row for each column."""
        rows = [(c, float(m), None if np.isnan(d) else float(d)) for c, m, d in zip(self.names, self.means, self.deviations)]
        return spark.createDataFrame(rows, "feature string, mean double, std double")

    def correlated(self, spark: SparkSession) -> DataFrame:
        """Correlation of every two columns, each pair once; null where one is constant."""
        r = self.correlations
        pairs = combinations_with_replacement(range(len(self.names)), 2)
        rows = [(self.names[i], self.names[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in pairs]
        return spark.createDataFrame(rows, "a string, b string, r double")

    def scaled(self, values: list[Column]) -> list[Column]:
        """Centred and divided by the sample deviation; a constant column becomes 0."""
        return [
            (v - F.lit(float(m))) / F.lit(float(d)) if d > 0 else F.lit(0.0)
            for v, m, d in zip(values, self.means, self.deviations)
        ]

    def components(self) -> Turned:
        """All principal components of the scaled columns, the largest first, each with its largest loading positive."""
        r = np.nan_to_num(self.correlations)
        shares, loadings = np.linalg.eigh(r)
        order = np.argsort(-shares, kind="stable")
        shares, loadings = np.maximum(shares[order], 0.0), loadings[:, order]
        for j in range(len(self.names)):
            size = abs(loadings[:, j])
            if loadings[int((size >= size.max() - 1e-9).argmax()), j] < 0:
                loadings[:, j] *= -1
        return Turned(self, loadings, shares / shares.sum() if shares.sum() else shares)


@dataclass(frozen=True)
class Turned:
    """Principal components: ``loadings`` has one column for each, ``explained`` its share of the variance."""

    moments: Moments
    loadings: np.ndarray
    explained: np.ndarray

    def enough(self, share: float) -> int:
        """The smallest number of components that together explain more than ``share``."""
        above = np.flatnonzero(np.cumsum(self.explained) > share)
        return int(above[0]) + 1 if len(above) else len(self.explained)

    def first(self, k: int) -> Turned:
        return Turned(self.moments, self.loadings[:, :k], self.explained[:k])

    def transform(self, df: DataFrame, out: str = "pcaFeatures") -> DataFrame:
        """Add the components of the columns as a vector, straight from the columns."""
        scaled = "__scaled"
        wide = df.withColumn(scaled, F.array(*self.moments.scaled([column(c).cast("double") for c in self.moments.names])))
        return wide.withColumn(out, array_to_vector(F.array(*map(self._component, self.loadings.T)))).drop(scaled)

    @staticmethod
    def _component(weights: np.ndarray) -> Column:
        terms = [F.get("__scaled", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)]
        return sum(terms[1:], terms[0])
