"""Evaluation of given predictions, models and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import index_name
from blotter.operators import ranking, scores
from blotter.operators.indexing import FrequencyIndexer
from blotter.operators.scaling import assemble
from blotter.operators.splits import train_test_split
from blotter.plans.outcomes import Outcome, Settings, index_task, train_outcome
from blotter.plans.tasks import CV_DEPTHS, CV_LEAF_SIZES, SWEEP_GRID, TASKS
from blotter.plans.tuning import FEATURES, cross_validate, sweep, tree, type_features
from blotter.queries.bindings import (
    INCIDENTS_SQL,
    JUDGED_SQL,
    MEAN_METRICS_SQL,
    bucket_sql,
    incidents,
    judged,
    mean_metrics,
    ranks_sql,
    scored,
)
from blotter.queries.registry import query
from blotter.queries.reports import ROC_SQL
from blotter.staging import tenure

# --- evaluation --------------------------------------------------------------


@query(
    "e1_accuracy",
    f"select round(avg(cast(label = prediction as double)), 9) as accuracy from ({JUDGED_SQL})",
)
def e1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.accuracy(scores.prediction_counts(judged(spark, sf_dir)))
    return found.select(F.round("accuracy", 9).alias("accuracy"))


@query(
    "e2_weighted_f1",
    f"""with j as ({JUDGED_SQL}),
             c as (select label as class, count(*) as support, count(*) filter (label = prediction) as hits
                   from j group by 1),
             p as (select prediction as class, count(*) as predicted from j group by 1)
        select round(sum(support * 2.0 * hits / (support + coalesce(predicted, 0))) / sum(support), 9) as f1
        from c left join p using (class)""",
)
def e2_weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.weighted_f1(scores.prediction_counts(judged(spark, sf_dir)))
    return found.select(F.round("f1", 9).alias("f1"))


@query(
    "e3_confusion_matrix",
    f"""select l.label, """
    + ", ".join(f'count(*) filter (j.prediction = {v}) as "{v}.0"' for v in range(5))
    + f""" from (values (0.0::double), (1.0), (2.0), (3.0), (4.0)) l(label)
          left join ({JUDGED_SQL}) j on j.label = l.label group by 1""",
)
def e3_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = scores.prediction_counts(judged(spark, sf_dir))
    return scores.confusion_matrix(counted, [float(v) for v in range(5)])


@query(
    "e4_roc_points",
    ROC_SQL + " select round(fpr, 9) as fpr, round(tpr, 9) as tpr, threshold from p",
)
def e4_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = scores.roc_points(scored(spark, sf_dir))
    return curve.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold")


@query(
    "e4_roc_corners",
    ROC_SQL
    + """, d as (select *, fpr - lag(fpr) over w as dx, tpr - lag(tpr) over w as dy,
                  lead(fpr) over w - fpr as nx, lead(tpr) over w - tpr as ny, row_number() over w as i
                from p window w as (order by threshold desc nulls first))
        select round(fpr, 9) as fpr, round(tpr, 9) as tpr, threshold from d
        where i <= 2 or nx is null or abs(nx - dx) > 1e-12 or abs(ny - dy) > 1e-12""",
)
def e4_roc_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve without the scores at which it goes straight on."""
    curve = scores.roc_points(scored(spark, sf_dir), drop_collinear=True)
    return curve.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold")


@query(
    "e5_roc_area_of_class",
    f"""with s as (select label, round(o_totalprice / 500000, 2) as score from ({JUDGED_SQL}) join orders using (o_orderkey)),
             c as (select score, count(*) filter (label = 2) as pos, count(*) filter (label <> 2) as neg from s group by 1),
             r as (select *, sum(pos) over (order by score desc) as tp from c)
        select round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 9)::double as auc from r""",
)
def e5_roc_area_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three label values, one of them positive: the others are negatives."""
    rows = judged(spark, sf_dir).join(scored(spark, sf_dir).select("o_orderkey", "score"), "o_orderkey")
    return scores.roc_area(rows, positive=2.0).select(F.round("auc", 9).alias("auc"))


@query("e5_roc_area", ROC_SQL + " select round(auc, 9) as auc from a")
def e5_roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.roc_area(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


# --- outcome models ----------------------------------------------------------

# The library's own forest, fitted on all training rows.
SETTINGS = Settings()

_trained: dict[tuple, Outcome] = {}


def _train(spark: SparkSession, sf_dir: str, task: str) -> Outcome:
    """The trained task; its staged predictions serve all queries on it of one application."""
    known = (tenure(spark), sf_dir, task)
    if known not in _trained:
        _trained[known] = train_outcome(incidents(spark, sf_dir), TASKS[task], SETTINGS)
    return _trained[known]


def _labelled_sql(label: str) -> str:
    """The incidents with the value of a label, and whether they are test rows."""
    value = """cast(hour(strptime("Date", '%m/%d/%Y %I:%M:%S %p')) as varchar)""" if label == "Hour" else f'"{label}"'
    return f"""select "ID", {value} as actual, {bucket_sql('"ID"', 42, 100)} < 25 as is_test from ({INCIDENTS_SQL})"""


def _register(number: int, task: str) -> None:
    name, labelled = f"r{number}_{task}", _labelled_sql(TASKS[task].label)

    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _train(spark, sf_dir, task).predictions

    @query(
        f"{name}_rows",
        f"""with l as ({labelled})
            select "ID", actual, true as known_class, true as score_in_range from l where is_test""",
    )
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The test rows with their own values; predictions are known classes, scores are shares."""
        outcome = _train(spark, sf_dir, task)
        score = F.col("score").between(0, 1) if TASKS[task].binary else F.lit(True)
        return outcome.predictions.select(
            "ID", "actual", F.col("predicted").isin(outcome.labels).alias("known_class"), score.alias("score_in_range")
        )

    @query(
        f"{name}_beats_majority",
        f"""with l as ({labelled}), c as (select actual, count(*) as n from l where is_test group by 1)
            select round(max(n) * 1.0 / sum(n), 9)::double as majority_share, true as more_accurate from c""",
    )
    def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
        outcome = _train(spark, sf_dir, task)
        share = outcome.predictions.groupBy("actual").count().agg((F.max("count") / F.sum("count")).alias("share"))
        return outcome.accuracy().crossJoin(share).select(
            F.round("share", 9).alias("majority_share"), (F.col("accuracy") > F.col("share")).alias("more_accurate")
        )


for _number, _task in enumerate(TASKS, start=1):
    _register(_number, _task)


HOUR = TASKS["hour"]
HOUR_SQL = f"""
    select *, cast(hour(strptime("Date", '%m/%d/%Y %I:%M:%S %p')) as varchar) as "Hour",
           {bucket_sql('"ID"', 42, 100)} < 25 as is_test
    from ({INCIDENTS_SQL})"""


def _training_table_sql(seen: str) -> str:
    """Indexes counted over the rows of ``seen``; other values have the number after the last."""
    columns = [(HOUR.label, "label"), *[(f, index_name(f)) for f in HOUR.features]]
    return (
        f"with i as ({HOUR_SQL}), tr as (select * from i where not is_test) select i.\"ID\", i.is_test, "
        + ", ".join(
            f"cast(coalesce(r{k}.rank, (select count(distinct \"{c}\") from {seen})) as double) as {name}"
            for k, (c, name) in enumerate(columns)
        )
        + " from i "
        + " ".join(
            f"""left join ({ranks_sql(seen, f'"{c}"')}) r{k} on r{k}.value = i."{c}\""""
            for k, (c, _) in enumerate(columns)
        )
    )


@query("r5_training_table", _training_table_sql("i"))
def r5_training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_task(incidents(spark, sf_dir), HOUR, SETTINGS)[0]


@query("r5_training_table_fit_on_train", _training_table_sql("tr"))
def r5_training_table_fit_on_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes from the training rows; values that only test rows have share the next number."""
    return index_task(incidents(spark, sf_dir), HOUR, Settings(fit_on="train"))[0]


@query("r7_forest_depth_30")
def r7_forest_depth_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest on features scaled once more, as a confusion matrix of class values."""
    return train_outcome(incidents(spark, sf_dir), TASKS["domestic"], Settings(rescale=True)).confusion()


@query("r8_class_predictions")
def r8_class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train(spark, sf_dir, "arrest").predictions.select("ID", "prediction", "predicted")


@query("r9_class_probability")
def r9_class_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train(spark, sf_dir, "arrest").predictions.select("ID", "score")


def _type_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ready = type_features(incidents(spark, sf_dir), split=(20, 1234))
    return ready.filter(~F.col("is_test")).drop("is_test"), ready.filter("is_test").drop("is_test")


@query("r10_decision_tree")
def r10_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _type_rows(spark, sf_dir)
    model = tree(maxDepth=15, minInstancesPerNode=3).fit(train)
    return model.transform(test).select("ID", "i_type", "prediction")


@query(
    "r10_tree_of_a_rule",
    f"""with i as ({INCIDENTS_SQL}), r as ({ranks_sql('i', '"District"')})
        select i."ID", cast(r.rank % 3 as double) as label, cast(r.rank % 3 as double) as prediction
        from i join r on r.value = i."District" where {bucket_sql('i."ID"', 1234, 100)} < 20""",
)
def r10_tree_of_a_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that one feature of 25 values decides: the tree, as deep as it needs, has to find it without error."""
    df = incidents(spark, sf_dir)
    ranked = FrequencyIndexer(["District"], ["rank"]).fit(df).transform(df).select("ID", "rank", (F.col("rank") % 3).alias("label"))
    train, test = train_test_split(assemble(ranked, ["rank"], FEATURES), ["ID"], 20, 1234)
    return tree(label="label", maxDepth=30, maxBins=32).fit(train).transform(test).select("ID", "label", "prediction")


# --- tuning ------------------------------------------------------------------


@query("r11_r12_cross_validation")
def r11_r12_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of 4 depths and 3 leaf sizes over 5 folds."""
    return _cross_validated(spark, sf_dir)


_results: dict[tuple, DataFrame] = {}


def _cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = (tenure(spark), sf_dir, "folds")
    if known not in _results:
        _results[known] = cross_validate(_type_rows(spark, sf_dir)[0], parallelism=8, fit_best=False).results
    return _results[known]


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = (tenure(spark), sf_dir, "sweep")
    if known not in _results:
        _results[known] = sweep(*_type_rows(spark, sf_dir), parallelism=8).results
    return _results[known]


_CV_POINTS = [(d, leaf) for d in CV_DEPTHS for leaf in CV_LEAF_SIZES]


@query(
    "r11_r12_grid",
    "select max_depth::double as max_depth, leaf::double as leaf, true as f1_in_range, 1 as marked from (values "
    + ", ".join(f"({d}, {leaf})" for d, leaf in _CV_POINTS)
    + ") g(max_depth, leaf), (select count(*) from events)",
)
def r11_r12_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the cross-validation: every point once, a mean F1 between 0 and 1, one marked row."""
    rows = _cross_validated(spark, sf_dir)
    marked = rows.agg(F.sum((F.col("bestModel") > 0).cast("int")).cast("int").alias("marked"))
    return rows.crossJoin(marked).select(
        "max_depth", F.col("minInstancesPerNode").alias("leaf"), F.col("avg_f1").between(0, 1).alias("f1_in_range"), "marked"
    )


@query(
    "r13_result_table",
    f"""select cut, avg_metric,
               case when row_number() over (order by avg_metric desc, seq) = 1 then 1000.0::double else 0.0::double end as "bestModel"
        from ({MEAN_METRICS_SQL})""",
)
def r13_result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mark_best(mean_metrics(spark, sf_dir), "avg_metric", "seq").drop("seq")


@query("r14_sweep")
def r14_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 90 points of the grid."""
    return _swept(spark, sf_dir)


@query(
    "r14_grid",
    "select max_depth::integer as max_depth, leaf::integer as leaf, true as f1_in_range, 1 as marked from (values "
    + ", ".join(f"({d}, {leaf})" for d, leaf in SWEEP_GRID)
    + ") g(max_depth, leaf), (select count(*) from events)",
)
def r14_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the sweep: every point once, F1 between 0 and 1, one marked row."""
    rows = _swept(spark, sf_dir)
    marked = rows.agg(F.sum((F.col("Best Model") > 0).cast("int")).cast("int").alias("marked"))
    return rows.crossJoin(marked).select(
        "max_depth",
        F.col("minInstancesPerNode").alias("leaf"),
        (F.col("training f1").between(0, 1) & F.col("testing f1").between(0, 1)).alias("f1_in_range"),
        "marked",
    )
