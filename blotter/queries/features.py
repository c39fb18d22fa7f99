"""Indexes, vectors, scaling, components and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.operators import scaling, splits
from blotter.operators.columns import vector_elements
from blotter.operators.counts import correlations
from blotter.operators.indexing import FrequencyIndexer, decode
from blotter.operators.moments import Moments
from blotter.plans.projection import project
from blotter.plans.tables import clean, encode
from blotter.plans.tasks import TYPE_FEATURES
from blotter.queries.bindings import (
    INCIDENTS_SQL,
    MEASURES,
    bucket_sql,
    incidents,
    ranks_sql,
)
from blotter.queries.registry import SQL, query, table

ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    # Adding zero turns a negative zero into zero.
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns]
    )


# --- indexes -----------------------------------------------------------------

INDEXED = {"o_orderpriority": "i_priority", "o_orderstatus": "i_status", "o_custkey": "i_customer", "o_totalprice": "i_price"}


@query(
    "x1_frequency_index",
    "select o_orderkey, "
    + ", ".join(f"cast({out}.rank as double) as {out}" for out in INDEXED.values())
    + " from orders "
    + " ".join(
        f"join ({ranks_sql('orders', c)}) {out} on {out}.value = cast(orders.{c} as varchar)"
        for c, out in INDEXED.items()
    ),
)
def x1_frequency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    indexed = FrequencyIndexer(list(INDEXED), list(INDEXED.values())).fit(df).transform(df)
    return indexed.select("o_orderkey", *INDEXED.values())


@query("x1_frequency_index_tail", SQL["x1_frequency_index"])
def x1_frequency_index_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with three entries broadcast, so that nearly every value is looked up by shuffle."""
    df = table(spark, sf_dir, "orders")
    indexer = FrequencyIndexer(list(INDEXED), list(INDEXED.values()), head_entries=3)
    return indexer.fit(df).transform(df).select("o_orderkey", *INDEXED.values())


@query(
    "x2_index_pipeline",
    f"with i as ({INCIDENTS_SQL}) select i.\"ID\", "
    + ", ".join(f'cast(r{k}.rank as double) as "{c}_index"' for k, c in enumerate(TYPE_FEATURES))
    + ", cast(label.rank as double) as i_type from i "
    + " ".join(
        f"""join ({ranks_sql('i', f'"{c}"')}) r{k} on r{k}.value = i."{c}\"""" for k, c in enumerate(TYPE_FEATURES)
    )
    + f""" join ({ranks_sql('i', '"Primary Type"')}) label on label.value = i."Primary Type\"""",
)
def x2_index_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = incidents(spark, sf_dir)
    outputs = [f"{c}_index" for c in TYPE_FEATURES]
    # One stage for features and label: the table is counted once.
    pipeline = Pipeline(stages=[FrequencyIndexer([*TYPE_FEATURES, "Primary Type"], [*outputs, "i_type"])])
    return pipeline.fit(df).transform(df).select("ID", *outputs, "i_type")


# --- vectors and scaling -----------------------------------------------------


@query("x3_assemble", "select l_orderkey, " + ", ".join(MEASURES) + " from lineitem")
def x3_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaling.assemble(table(spark, sf_dir, "lineitem"), MEASURES).select("l_orderkey", "features")
    return vector_elements(vectors, "features", MEASURES).drop("features")


def _z(name: str, deviation: str) -> str:
    return f"round(({name} - avg({name}) over ()) / {deviation}({name}) over (), 6) + 0.0 as {name}"


@query(
    "x4_standardize",
    f"select {ROW_ID} as row_id, " + ", ".join(_z(c, "stddev_samp") for c in MEASURES) + " from lineitem",
)
def x4_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("row_id", F.expr(ROW_ID))
    scaled = scaling.standardize(scaling.assemble(df, MEASURES)).select("row_id", "scaled_features")
    return _rounded(vector_elements(scaled, "scaled_features", MEASURES).drop("scaled_features"), MEASURES)


@query(
    "x5_rescale_by_training_rows",
    f"""with d as (select *, {bucket_sql('o_orderkey', 42, 100)} < 25 as is_test from orders),
             s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as d from d where not is_test)
        select o_orderkey, is_test, round((o_totalprice - s.m) / s.d, 6) + 0.0 as price, 0.0::double as constant
        from d, s""",
)
def x5_rescale_by_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("seven", F.lit(7.0))
    flagged = splits.with_split(scaling.assemble(df, ["o_totalprice", "seven"]), ["o_orderkey"])
    scaler = scaling.PopulationScaler.fit(flagged.filter(~F.col("is_test")), "features")
    scaled = scaler.transform(flagged, "features", "scaled").select("o_orderkey", "is_test", "scaled")
    return _rounded(vector_elements(scaled, "scaled", ["price", "constant"]).drop("scaled"), ["price", "constant"])


# --- components --------------------------------------------------------------

PAIR = ["l_quantity", "l_discount"]
PAIR_SQL = f"""
    select {ROW_ID} as row_id,
           (l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over () as z1,
           (l_discount - avg(l_discount) over ()) / stddev_samp(l_discount) over () as z2,
           corr(l_quantity, l_discount) over () as r
    from lineitem"""


def _scaled_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("row_id", F.expr(ROW_ID))
    return scaling.standardize(scaling.assemble(df, PAIR)).select("row_id", "scaled_features")


@query("x6_pca_features")
def x6_pca_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = 9
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    scaled = scaling.standardize(vectors)
    reduced = scaling.fit_components(scaled, width).transform(scaled)
    names = [f"pca{i + 1}" for i in range(width)]
    return vector_elements(reduced.select("vec_id", "label", "pcaFeatures"), "pcaFeatures", names).drop("pcaFeatures")


def _all_components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    df = table(spark, sf_dir, "lineitem").withColumn("row_id", F.expr(ROW_ID))
    scaled = scaling.standardize(scaling.assemble(df, MEASURES)).select("row_id", "scaled_features")
    names = [f"pca{i + 1}" for i in range(len(MEASURES))]
    reduced = scaling.fit_components(scaled, len(names)).transform(scaled)
    return vector_elements(reduced.select("row_id", "pcaFeatures"), "pcaFeatures", names), names


@query(
    "x6_all_components_keep_lengths",
    "select row_id, round("
    + " + ".join(f"z{i} * z{i}" for i in range(len(MEASURES)))
    + f", 4) as squares from (select {ROW_ID} as row_id, "
    + ", ".join(f"({c} - avg({c}) over ()) / stddev_samp({c}) over () as z{i}" for i, c in enumerate(MEASURES))
    + " from lineitem)",
)
def x6_all_components_keep_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of n features only turn the rows: each keeps its sum of squares."""
    points, names = _all_components(spark, sf_dir)
    return points.select("row_id", F.round(sum(F.col(c) * F.col(c) for c in names), 4).alias("squares"))


@query(
    "x6_components_are_uncorrelated",
    "select a, b, true as uncorrelated from (values "
    + ", ".join(f"('pca{i}', 'pca{j}')" for i in range(1, len(MEASURES)) for j in range(i + 1, len(MEASURES) + 1))
    + ") p(a, b), (select count(*) from lineitem)",
)
def x6_components_are_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, names = _all_components(spark, sf_dir)
    return correlations(points, names).filter("a < b").select("a", "b", (F.abs("r") < 1e-6).alias("uncorrelated"))


@query(
    "x7_pca_two",
    # Four digits: the two columns hardly correlate, so the eigenvalues are close and the computed
    # loadings are less exact. At sf0.1 the scores are up to 2e-9 off the closed form (measured; the
    # standardised inputs agree to 1e-12), enough to tip a value over the edge of the sixth digit.
    f"""select row_id, round((z1 + sign(r) * z2) / sqrt(2), 4) + 0.0 as pca1,
               round((z1 - sign(r) * z2) / sqrt(2), 4) + 0.0 as pca2 from ({PAIR_SQL})""",
)
def x7_pca_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled_pair(spark, sf_dir)
    reduced = scaling.fit_components(scaled, 2).transform(scaled).select("row_id", "pcaFeatures")
    names = ["pca1", "pca2"]
    return _rounded(vector_elements(reduced, "pcaFeatures", names).drop("pcaFeatures"), names, 4)


@query(
    "x8_explained_variance",
    """with c as (select abs(corr(l_quantity, l_discount)) as r from lineitem)
       select 1 as component, round((1 + r) / 2, 6) as share, round((1 + r) / 2, 6) as total from c
       union all select 2, round((1 - r) / 2, 6), 1.0 from c""",
)
def x8_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled_pair(spark, sf_dir)
    return _rounded(scaling.explained_rows(scaled, scaling.fit_components(scaled, 2)), ["share", "total"])


@query(
    "x9_choose_k",
    """with c as (select abs(corr(l_quantity, l_extendedprice)) as r from lineitem)
       select t.threshold, case when (1 + r) / 2 > t.threshold then 1 else 2 end as k
       from c, (values (0.4::double), (0.9::double)) t(threshold)""",
)
def x9_choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = scaling.assemble(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    scaled = scaling.standardize(pair)
    rows = [(t, scaling.choose_k(scaled, t)) for t in (0.4, 0.9)]
    return spark.createDataFrame(rows, "threshold double, k int")


@query(
    "x7_one_pass",
    f"""select row_id, round((z1 + sign(r) * z2) / sqrt(2), 4) + 0.0 as pca1,
               round((z1 - sign(r) * z2) / sqrt(2), 4) + 0.0 as pca2 from ({PAIR_SQL})""",
)
def x7_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales and components from one row of aggregates."""
    df = table(spark, sf_dir, "lineitem").withColumn("row_id", F.expr(ROW_ID))
    reduced = Moments.fit(df, PAIR).components().first(2).transform(df).select("row_id", "pcaFeatures")
    names = ["pca1", "pca2"]
    return _rounded(vector_elements(reduced, "pcaFeatures", names).drop("pcaFeatures"), names, 4)


@query(
    "a9_a10_one_pass",
    "select a, b, round(mean, 5) as mean, round(std, 5) as std, round(r, 5) as r from ("
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, avg({a}) as mean, stddev_samp({a}) as std, corr({a}, {b}) as r from lineitem"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i:]
    )
    + ")",
)
def a9_a10_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with mean and deviation of the first column; halves of the table are merged."""
    df = table(spark, sf_dir, "lineitem")
    halves = [Moments.fit(df.filter(F.col("l_linenumber") % 2 == i), MEASURES) for i in (0, 1)]
    whole = halves[0].merged(halves[1])
    described = whole.described(spark).withColumnRenamed("feature", "a")
    return _rounded(whole.correlated(spark).join(described, "a").select("a", "b", "mean", "std", "r"), ["mean", "std", "r"], 5)


@query(
    "x9_explained_components",
    """with c as (select abs(corr(l_quantity, l_extendedprice)) as r from lineitem)
       select t.threshold, case when (1 + r) / 2 > t.threshold then 1 else 2 end as k, case when (1 + r) / 2 > t.threshold then 1 else 2 end as width
       from c, (values (0.4::double), (0.9::double), (0.999999::double)) t(threshold)""",
)
def x9_explained_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many components as explain the share: their number, and the width of the vectors made with it."""
    df = table(spark, sf_dir, "lineitem")
    turned = Moments.fit(df, ["l_quantity", "l_extendedprice"]).components()
    rows = [(t, turned.enough(t)) for t in (0.4, 0.9, 0.999999)]
    wide = [
        turned.first(k).transform(df).agg(F.lit(t).alias("threshold"), F.lit(k).alias("k"), F.max(F.size(vector_to_array("pcaFeatures"))).alias("width"))
        for t, k in rows
    ]
    return reduce(DataFrame.unionByName, wide)


@query("projection")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view: clean, encode, drop, cast, scale and reduce to two components."""
    return project(encode(clean(incidents(spark, sf_dir)))).points


# --- splits ------------------------------------------------------------------


@query(
    "l1_train_test_split",
    f"select o_orderkey, {bucket_sql('o_orderkey', 42, 100)} < 25 as is_test from orders",
)
def l1_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_split(table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query(
    "l2_train_test_split_80_20",
    f"""select event_id, 'test' as part from events where {bucket_sql('event_id', 1234, 100)} < 20
        union all
        select event_id, 'train' from events where {bucket_sql('event_id', 1234, 100)} >= 20""",
)
def l2_train_test_split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splits.train_test_split(table(spark, sf_dir, "events"), ["event_id"], 20, 1234)
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part"))
    )


@query(
    "l3_folds",
    f"select event_id, cast({bucket_sql('event_id', 'fold:42', 5)} as integer) as fold from events",
)
def l3_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_folds(table(spark, sf_dir, "events"), ["event_id"]).select("event_id", "fold")


@query(
    "r15_decode_labels",
    "select o_orderkey, o_orderpriority as label from orders",
)
def r15_decode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    model = FrequencyIndexer(["o_orderpriority"], ["prediction"]).fit(df)
    indexed = model.transform(df).select("o_orderkey", "prediction")
    return decode(indexed, "prediction", model.labels("o_orderpriority"), "label").drop("prediction")
