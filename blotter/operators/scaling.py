"""Feature vectors, standardisation and principal components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """The named columns as one vector, in order; a null is an error."""
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="error").transform(df)


def standardize(
    df: DataFrame, vector: str = "features", out: str = "scaled_features", fit_rows: DataFrame | None = None
) -> DataFrame:
    """Centre and divide by the sample standard deviation; a constant feature becomes 0.

    Mean and deviation are those of ``fit_rows``, by default of ``df`` itself.
    """
    scaler = StandardScaler(inputCol=vector, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df if fit_rows is None else fit_rows).transform(df)


def _width(rows: DataFrame, values: str) -> int:
    """The length of the arrays of a column, which is the same in all rows."""
    first = rows.select(F.size(values)).first()
    if first is None:
        raise ValueError("no rows to fit on")
    return first[0]


@dataclass(frozen=True)
class PopulationScaler:
    """Centres by the mean and divides by the population deviation of the rows it was fitted on.

    A constant feature is only centred.
    """

    means: list[float]
    deviations: list[float]

    @staticmethod
    def fit(df: DataFrame, vector: str) -> PopulationScaler:
        x = F.col("x")
        rows = df.select(vector_to_array(column(vector)).alias("x"))
        width = _width(rows, "x")
        row = rows.agg(
            *[F.avg(x[i]) for i in range(width)], *[F.stddev_pop(x[i]) for i in range(width)]
        ).first()
        return PopulationScaler(list(row[:width]), [d if d else 1.0 for d in row[width:]])

    def scaled(self, vector: str) -> Column:
        means = F.array(*[F.lit(m) for m in self.means])
        deviations = F.array(*[F.lit(d) for d in self.deviations])
        centred = F.zip_with(vector_to_array(column(vector)), means, lambda x, m: x - m)
        return array_to_vector(F.zip_with(centred, deviations, lambda x, d: x / d))

    def transform(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        return df.withColumn(out, self.scaled(vector))


@dataclass(frozen=True)
class Components:
    """Fitted principal components with a settled sign.

    A component may point either way. Here its largest loading is positive (the first of them,
    if several are equally large), so that results can be compared between runs.
    """

    model: PCAModel
    signs: list[float]

    @property
    def explained(self) -> list[float]:
        return [float(v) for v in self.model.explainedVariance.toArray()]

    def transform(self, df: DataFrame, out: str = "pcaFeatures") -> DataFrame:
        raw = "__components"
        signs = F.array(*[F.lit(s) for s in self.signs])
        turned = F.zip_with(vector_to_array(F.col(raw)), signs, lambda x, s: x * s)
        projected = self.model.copy({self.model.outputCol: raw}).transform(df)
        return projected.withColumn(out, array_to_vector(turned)).drop(raw)


def fit_components(df: DataFrame, k: int, vector: str = "scaled_features") -> Components:
    model = PCA(k=k, inputCol=vector, outputCol="__components").fit(df)
    loadings = model.pc.toArray()
    signs = []
    for j in range(k):
        size = abs(loadings[:, j])
        first = int((size >= size.max() - 1e-9).argmax())
        signs.append(1.0 if loadings[first, j] >= 0 else -1.0)
    return Components(model, signs)


def explained_rows(df: DataFrame, components: Components) -> DataFrame:
    """Share of the variance per component and up to it; one row per component."""
    rows, upto = [], 0.0
    for i, share in enumerate(components.explained):
        upto += share
        rows.append((i + 1, share, upto))
    return df.sparkSession.createDataFrame(rows, "component int, share double, total double")


def choose_k(df: DataFrame, threshold: float, vector: str = "scaled_features") -> int:
    """The smallest number of components that together explain more than ``threshold``."""
    width = _width(df.select(vector_to_array(column(vector)).alias("x")), "x")
    upto = 0.0
    for k, share in enumerate(fit_components(df, width, vector).explained, start=1):
        upto += share
        if upto > threshold:
            return k
    return width
