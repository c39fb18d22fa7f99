"""What each prediction task predicts, and from which columns."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Feature lists in the order of the feature vector.
# ---------------------------------------------------------------------------

ARREST_FEATURES = [
    "Date", "IUCR", "Primary Type", "Description", "Location Description", "Year", "Block",
    "Domestic", "District", "Ward", "FBI Code", "Community Area", "Latitude", "Longitude",
]

DOMESTIC_FEATURES = [
    "Date", "IUCR", "Primary Type", "Description", "Location Description", "Year", "Block",
    "Arrest", "District", "Ward", "FBI Code", "Community Area", "Latitude", "Longitude",
]

DISTRICT_FEATURES = [
    "Date", "IUCR", "Primary Type", "Description", "Location Description", "Arrest", "Year",
    "Block", "Domestic", "Ward", "FBI Code", "Community Area", "Latitude", "Longitude",
]

DISTRICT_PCA_FEATURES = [
    "Date", "IUCR", "Primary Type", "Description", "Location Description", "Year", "Block",
    "Arrest", "Domestic", "Ward", "FBI Code", "Community Area", "Latitude", "Longitude",
]

HOUR_FEATURES = [
    "Date", "IUCR", "Primary Type", "Description", "Location Description", "Year", "Block",
    "Domestic", "District", "Ward", "FBI Code", "Community Area", "Latitude", "Longitude", "Arrest",
]

TYPE_FEATURES = [
    "Date", "IUCR", "Location Description", "Arrest", "Domestic", "FBI Code", "Year", "Ward",
    "Latitude", "Longitude",
]

COMPONENTS = 9

# Grid of the cross-validation.
CV_DEPTHS = [30, 25, 20, 15]
CV_LEAF_SIZES = [3, 5, 7]

# The sweep: leaf sizes 2 to 6 up to depth 11, 2 to 5 for deeper trees.
SWEEP_GRID = [
    (depth, leaf)
    for depth in [*range(2, 21), 25]
    for leaf in (range(2, 7) if depth <= 11 else range(2, 6))
]

# How the best row of a tuning result is marked.
BEST_MARK = 1000

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    """Predict ``label`` from ``features``, reduced to ``components`` if given."""

    name: str
    label: str
    features: list[str]
    components: int | None = None
    binary: bool = False


TASKS = {
    t.name: t
    for t in [
        Task("arrest", "Arrest", ARREST_FEATURES, COMPONENTS, binary=True),
        Task("domestic", "Domestic", DOMESTIC_FEATURES, COMPONENTS, binary=True),
        Task("district", "District", DISTRICT_FEATURES),
        Task("district_pca", "District", DISTRICT_PCA_FEATURES, COMPONENTS),
        Task("hour", "Hour", HOUR_FEATURES),
        Task("hour_pca", "Hour", HOUR_FEATURES, COMPONENTS),
    ]
}
