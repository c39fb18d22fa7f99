"""The supplied tables in the roles that the operators expect.

Each binding exists twice, as a DataFrame and as SQL that yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.queries.registry import table

# Orders with year, month, date text and an outcome.
ORDERS_SQL = """
select *, cast(year(o_orderdate) as integer) as year,
       strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') as date_text,
       o_orderstatus = 'F' as filled
from orders"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "*",
        F.year("o_orderdate").alias("year"),
        F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("date_text"),
        (F.col("o_orderstatus") == "F").alias("filled"),
    )


# Events as incident records: the 17 fields, all text but the key.
INCIDENTS_SQL = """
select event_id as "ID",
       'E' || lpad(cast(event_id as varchar), 12, '0') as "Case Number",
       strftime(ts, '%m/%d/%Y %I:%M:%S %p') as "Date",
       lpad(cast(user_id as varchar), 8, '0') || ' USER AVE' as "Block",
       k as "IUCR",
       upper(event_type) as "Primary Type",
       upper(event_type) || ' / CODE ' || substr(k, 1, 1) as "Description",
       case when user_id % 3 = 0 then 'STREET' else 'AREA ' || cast(user_id % 12 as varchar) end as "Location Description",
       case when value > 70 then 'TRUE' else 'FALSE' end as "Arrest",
       case when cast(k as integer) < 20 then 'TRUE' else 'FALSE' end as "Domestic",
       cast(user_id % 25 as varchar) as "District",
       cast(hour(ts) * 2 + user_id % 2 as varchar) as "Ward",
       cast(user_id % 77 as varchar) as "Community Area",
       lpad(cast(cast(k as integer) % 26 as varchar), 2, '0') || 'A' as "FBI Code",
       cast(year(ts) as varchar) as "Year",
       '41.' || lpad(cast(cast(round(value * 100) as bigint) as varchar), 6, '0') as "Latitude",
       '-87.' || lpad(cast(user_id * 7 % 1000 as varchar), 6, '0') as "Longitude"
from (select *, regexp_extract(props, '[0-9]+') as k from events)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    user, code = F.col("user_id"), F.col("k").cast("int")

    def padded(value, width):
        return F.lpad(value.cast("string"), width, "0")

    def flag(condition):
        return F.when(condition, "TRUE").otherwise("FALSE")

    kind = F.upper("event_type")
    return e.select(
        F.col("event_id").alias("ID"),
        F.concat(F.lit("E"), padded(F.col("event_id"), 12)).alias("Case Number"),
        F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("Date"),
        F.concat(padded(user, 8), F.lit(" USER AVE")).alias("Block"),
        F.col("k").alias("IUCR"),
        kind.alias("Primary Type"),
        F.concat(kind, F.lit(" / CODE "), F.substring("k", 1, 1)).alias("Description"),
        F.when(user % 3 == 0, "STREET")
        .otherwise(F.concat(F.lit("AREA "), (user % 12).cast("string")))
        .alias("Location Description"),
        flag(F.col("value") > 70).alias("Arrest"),
        flag(code < 20).alias("Domestic"),
        (user % 25).cast("string").alias("District"),
        (F.hour("ts") * 2 + user % 2).cast("string").alias("Ward"),
        (user % 77).cast("string").alias("Community Area"),
        F.concat(padded(code % 26, 2), F.lit("A")).alias("FBI Code"),
        F.year("ts").cast("string").alias("Year"),
        F.concat(F.lit("41."), padded(F.round(F.col("value") * 100).cast("long"), 6)).alias("Latitude"),
        F.concat(F.lit("-87."), padded(user * 7 % 1000, 6)).alias("Longitude"),
    )


# The numeric features of lineitem.
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Orders judged by a rule: the label is the status, the prediction a price band.
# Band 4 never is a label, so some classes are predicted and never met.
JUDGED_SQL = """
select o_orderkey, case o_orderstatus when 'F' then 0.0 when 'O' then 1.0 else 2.0 end as label,
       cast(floor(o_totalprice / 120000) as double) as prediction
from orders"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "F", 0.0).when(status == "O", 1.0).otherwise(2.0).alias("label"),
        F.floor(F.col("o_totalprice") / 120000).cast("double").alias("prediction"),
    )


# Orders with a score for being filled.
SCORED_SQL = """
select o_orderkey, cast(o_orderstatus = 'F' as integer) as label,
       round(o_totalprice / 500000, 2) as score
from orders"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(F.col("o_totalprice") / 500000, 2).alias("score"),
    )


# A rule "filled if the price is above a cut" judged per fold: hits per (cut, fold).
CUTS = [100000, 200000, 300000, 400000]
FOLD_SQL = "cast(cast('0x' || substr(md5('fold:42:' || o_orderkey), 1, 8) as bigint) % 5 as integer)"
FOLD_METRICS_SQL = " union all ".join(
    f"select {i} as seq, cast({cut} as double) as cut, fold, "
    f"avg(cast((o_totalprice > {cut}) = (o_orderstatus = 'F') as double)) as metric "
    f"from (select *, {FOLD_SQL} as fold from orders) group by fold"
    for i, cut in enumerate(CUTS)
)
MEAN_METRICS_SQL = (
    f"select seq, cut, round(avg(metric), 9) as avg_metric from ({FOLD_METRICS_SQL}) group by seq, cut"
)


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.operators.splits import with_folds

    folded = with_folds(table(spark, sf_dir, "orders"), ["o_orderkey"])
    filled = F.col("o_orderstatus") == "F"
    hits = [
        F.avg(((F.col("o_totalprice") > cut) == filled).cast("double")).alias(f"hit_{i}")
        for i, cut in enumerate(CUTS)
    ]
    per_fold = folded.groupBy("fold").agg(*hits)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("seq"), F.lit(float(cut)).alias("cut"), F.col(f"hit_{i}").alias("metric")
            )
            for i, cut in enumerate(CUTS)
        ]
    )
    return per_fold.select("fold", F.inline(rows))


def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.operators.counts import mean_metric

    means = mean_metric(fold_metrics(spark, sf_dir), ["seq", "cut"], "metric")
    return means.withColumn("avg_metric", F.round("avg_metric", 9))


def ranks_sql(source: str, name: str) -> str:
    """Frequency ranks of one column: ``(value, rank)``."""
    return (
        f"select value, row_number() over (order by n desc, value) - 1 as rank from "
        f"(select cast({name} as varchar) as value, count(*) as n from {source} "
        f"where {name} is not null group by 1)"
    )


def bucket_sql(key: str, seed: int | str, buckets: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint) % {buckets}"


# The characters that separate tokens, as a SQL literal.
SEPARATORS_SQL = """'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10)"""


def tokens_sql(text: str) -> str:
    return (
        f"list_filter(string_split(translate(lower({text}), {SEPARATORS_SQL}, repeat(' ', 33)), ' '), "
        "lambda w: w <> '')"
    )
