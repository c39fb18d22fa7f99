"""Train and judge a random forest for one of the prediction tasks."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.dates import hour_of
from blotter.functions.names import column, index_name
from blotter.operators.filters import drop_null_keys
from blotter.operators.indexing import FrequencyIndexer, FrequencyIndexModel, decode
from blotter.operators.moments import Moments
from blotter.operators.scaling import PopulationScaler
from blotter.operators.charts import confusion_heatmap, roc_chart
from blotter.operators.scores import accuracy, area, confusion_matrix, curve, prediction_counts, ranked_scores
from blotter.operators.splits import key_bucket, with_split
from blotter.plans.deep_forests import with_forest_votes
from blotter.plans.forests import with_votes
from blotter.plans.tasks import Task
from blotter.schema import KEY
from blotter.staging import stage

# Bounded rows to fit on have at least so many partitions, and more where these would get more rows than that.
FIT_PARTITIONS, FIT_ROWS = 4, 10_000
# On more rows than these the forest is grown in parts (:mod:`blotter.plans.deep_forests`).
WHOLE_ROWS = 2_000


@dataclass(frozen=True)
class Forest:
    """Size of the forest. Nodes stop at ``depth``, which Spark allows to be 30 at most."""

    trees: int = 100
    depth: int = 30
    seed: int = 42
    bins: int = 32
    memory_mb: int = 512

    def estimator(self, label: str, features: str) -> RandomForestClassifier:
        return RandomForestClassifier(
            labelCol=label,
            featuresCol=features,
            numTrees=self.trees,
            maxDepth=self.depth,
            maxBins=self.bins,
            impurity="gini",
            featureSubsetStrategy="sqrt",
            maxMemoryInMB=self.memory_mb,
            seed=self.seed,
        )


@dataclass(frozen=True)
class Settings:
    """How to train.

    ``fit_on`` says whether the frequency indexes see ``"all"`` rows or the training rows only.
    They read no label, so all rows is the default: most values of a column such as Date stand
    in one row, and under an index of the training rows nearly every test row would have the
    one number of unseen values, outside the range that the trees know. Scaler, components and
    trees see the training rows only. ``labelled_rows`` bounds how many of those the trees are
    fitted on (about; the key's hash chooses), by default all. ``exclude`` leaves features out,
    for inputs that give the answer away. ``numeric`` takes columns as the numbers they are, not
    by frequency rank; a value that is no number, or missing, counts as the mean of the training
    rows. ``rescale`` scales the features once more by the training rows, which trees do not need.
    ``explained`` takes, for tasks with components, as many as explain more than that share of the
    variance instead of the task's fixed number.
    """

    key: str = KEY
    fit_on: str = "all"
    test_percent: int = 25
    seed: int = 42
    exclude: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    rescale: bool = False
    explained: float | None = None
    labelled_rows: int | None = None
    forest: Forest = field(default_factory=Forest)


@dataclass(frozen=True)
class Outcome:
    """A trained task: ``predictions``, staged, has the test rows with label, prediction and their values.

    ``positive`` is the class that ``score`` speaks of, for two classes the rarer one. ``forest`` is there if it was
    fitted on few rows; one that is grown in parts has as many nodes as rows, and only its votes are kept.
    """

    task: Task
    labels: list[str]
    explained: list[float]
    indexer: FrequencyIndexModel
    forest: RandomForestClassificationModel | None
    predictions: DataFrame
    positive: str | None = None

    def counts(self) -> DataFrame:
        return prediction_counts(self.predictions, "actual", "predicted")

    def accuracy(self) -> DataFrame:
        return accuracy(self.counts())

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.counts(), self.labels)

    def ranked(self) -> DataFrame:
        """The test rows counted by score, for curve and area."""
        return ranked_scores(self.predictions, "actual", "score", self.positive)

    def roc_points(self) -> DataFrame:
        return curve(self.ranked())

    def roc_area(self) -> DataFrame:
        return area(self.ranked())

    def charts(self) -> dict[str, DataFrame]:
        """The tables behind the heat map of the confusion and, for two classes, the ROC chart."""
        found = {"confusion_chart": confusion_heatmap(self.confusion(), {v: v for v in self.labels})}
        if self.positive is not None:
            ranked = self.ranked()
            auc = area(ranked).first()["auc"]
            found["roc_chart"] = roc_chart(curve(ranked), float("nan") if auc is None else auc)
        return found


def with_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("Hour", hour_of(F.col("Date")))


def label_attribute(labels: list[str]) -> dict:
    """Column metadata that tells the classifier how many classes there are."""
    return {"ml_attr": {"type": "nominal", "vals": [str(v) for v in labels]}}


def index_task(df: DataFrame, task: Task, settings: Settings) -> tuple[DataFrame, FrequencyIndexModel]:
    """Key, test flag, label and indexed features, staged: training reads them many times.

    A row without a label can neither be trained on nor judged, and is left out.
    """
    if task.label == "Hour" and "Hour" not in df.columns:
        df = with_hour(df)
    features = [f for f in task.features if f not in settings.exclude]
    indexed = [f for f in features if f not in settings.numeric] + [task.label]
    keep = [column(c) for c in dict.fromkeys([settings.key, *features, task.label])]
    labelled = drop_null_keys(df.select(*keep), [task.label])
    flagged = with_split(labelled, [settings.key], settings.test_percent, settings.seed)
    # A missing value, and with ``fit_on="train"`` one that only test rows have, gets the number after the last.
    seen = flagged.filter(~F.col("is_test")) if settings.fit_on == "train" else flagged
    indexer = FrequencyIndexer(indexed, handleInvalid="keep").fit(seen)
    means = {}
    if settings.numeric:
        found = flagged.filter(~F.col("is_test")).agg(*[F.avg(column(f).try_cast("double")) for f in settings.numeric]).first()
        means = {f: m if m is not None else 0.0 for f, m in zip(settings.numeric, found)}
    numbers = [
        F.coalesce(column(f).try_cast("double"), F.lit(means[f])).alias(index_name(f)) if f in means else F.col(index_name(f))
        for f in features
    ]
    ready = indexer.transform(flagged).select(
        column(settings.key), "is_test", F.col(index_name(task.label)).alias("label"), *numbers
    )
    return stage(ready, task.name), indexer


def _fitted(rows: DataFrame, vector: str, settings: Settings) -> RandomForestClassificationModel:
    """Spark's forest of these rows."""
    if settings.labelled_rows is not None:
        # The learner keeps, and shuffles, statistics of all nodes in work for every partition: those follow the rows
        # it is fitted on, not the table they come from. It also draws by partition and place, which now depend on the key.
        pieces = max(FIT_PARTITIONS, ceil(settings.labelled_rows / FIT_ROWS))
        rows = rows.repartition(pieces, column(settings.key)).sortWithinPartitions(column(settings.key))
    # The forest reads its rows several times before it keeps a compact copy of its own.
    training = rows.select("label", vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return settings.forest.estimator("label", vector).fit(training)
    finally:
        training.unpersist()


def train_outcome(df: DataFrame, task: Task, settings: Settings = Settings()) -> Outcome:
    ready, indexer = index_task(df, task, settings)
    labels = indexer.labels(task.label)
    ready = ready.withMetadata("label", label_attribute(labels))
    inputs = [index_name(f) for f in task.features if f not in settings.exclude]
    in_training = ~F.col("is_test")

    # One pass over the training rows gives scales and components; a row is scaled and turned in one go.
    moments = Moments.fit(ready.filter(in_training), inputs)
    components, k = moments.components(), task.components
    if k and settings.explained is not None:
        k = components.enough(settings.explained)
    if k:
        vector, explained = "pcaFeatures", [float(v) for v in components.explained[:k]]
        featured = components.first(k).transform(ready, vector)
    else:
        vector, explained = "scaled_features", []
        featured = ready.withColumn(vector, array_to_vector(F.array(*moments.scaled([column(c) for c in inputs]))))
    if settings.rescale:
        scaler = PopulationScaler.fit(featured.filter(in_training), vector)
        featured = scaler.transform(featured, vector, "rescaled_features")
        vector = "rescaled_features"

    learn, n = in_training, moments.n
    if settings.labelled_rows is not None:
        share = int(min(1.0, settings.labelled_rows / max(1, n)) * 1_000_000)
        learn, n = in_training & (key_bucket([settings.key], settings.seed, 1_000_000, "fit") < share), min(n, settings.labelled_rows)
    rows = featured.select(column(settings.key), "label", vector, "is_test")
    if n > WHOLE_ROWS:
        model, size = None, settings.forest
        scored = with_forest_votes(
            rows, vector, "label", learn, F.col("is_test"), len(labels), size.trees, size.depth, size.seed, size.bins
        )
    else:
        model = _fitted(rows.filter(learn), vector, settings)
        scored = with_votes(model, rows.filter("is_test").drop("is_test"), vector)
    # The score is the share of trees for the rarer class, which has the second label.
    scored = scored.select(column(settings.key), "label", "prediction", *(["score"] if task.binary else []))
    named = decode(decode(scored, "label", labels, "actual"), "prediction", labels, "predicted")
    # Accuracy, curves and charts read them again and again; the forest is applied once.
    positive = labels[1] if task.binary and len(labels) > 1 else None
    return Outcome(task, labels, explained, indexer, model, stage(named, "predictions"), positive)
