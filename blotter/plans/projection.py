"""The two-component view of an encoded incident table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from blotter.functions.names import column
from blotter.operators.columns import cast_columns, drop_columns, vector_elements
from blotter.operators.moments import Moments, Turned
from blotter.schema import KEY, PROJECTION_CASTS, PROJECTION_DROPS
from blotter.staging import stage


@dataclass(frozen=True)
class Projection:
    """``points (key, pca1, pca2)`` and the components they come from."""

    points: DataFrame
    components: Turned


def project(
    encoded: DataFrame,
    key: str = KEY,
    drops: list[str] = PROJECTION_DROPS,
    casts: list[str] = PROJECTION_CASTS,
) -> Projection:
    """Every column that is left after the drops is a feature."""
    left = drop_columns(encoded, drops)
    features = [c for c in left.columns if c != key]
    # Whatever a file's types were, coordinates written as text included, features are numbers.
    texts = [f.name for f in left.schema.fields if f.name in features and f.dataType.simpleString() == "string"]
    numbers = stage(cast_columns(left, list(dict.fromkeys([*casts, *texts]))), "projection")
    components = Moments.fit(numbers, features).components().first(2)
    turned = components.transform(numbers)
    points = vector_elements(turned, "pcaFeatures", ["pca1", "pca2"])
    return Projection(points.select(column(key), "pca1", "pca2"), components)
