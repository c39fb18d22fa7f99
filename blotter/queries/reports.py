"""Counts, chart tables and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.operators import charts, counts, matrices, ranking, scores
from blotter.plans.reports import incident_reports
from blotter.queries.bindings import (
    INCIDENTS_SQL,
    MEAN_METRICS_SQL,
    MEASURES,
    ORDERS_SQL,
    SCORED_SQL,
    incidents,
    mean_metrics,
    orders,
    scored,
    tokens_sql,
)
from blotter.queries.registry import query, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# A list of its own order, with one entry that does not occur.
NAMED = ["5-LOW", "1-URGENT", "0-NONE", "3-MEDIUM"]


def _cells(values: list[str], empty_is_null: bool = False) -> str:
    cell = "count(*) filter (o_orderpriority = '{v}')"
    if empty_is_null:
        cell = f"nullif({cell}, 0)"
    return ", ".join(cell.format(v=v) + f' as "{v}"' for v in values)


def _matrix_sql(key: str, values: list[str], empty_is_null: bool = False) -> str:
    return f"select {key}, {_cells(values, empty_is_null)} from ({ORDERS_SQL}) group by 1"


def _long_sql(key: str, values: list[str], empty_is_null: bool = False) -> str:
    """The cells of a matrix, one row each, with the number of the series."""
    return " union all ".join(
        f"""select x, {i} as no, '{v}' as series, "{v}" as value from
        (select {key} as x, {_cells([v], empty_is_null)} from ({ORDERS_SQL}) group by 1)"""
        for i, v in enumerate(values)
    )


def _stack_sql(long: str) -> str:
    return f"""
    select x, series, value,
           cast(sum(value) over w - value as bigint) as y0, cast(sum(value) over w as bigint) as y1
    from ({long}) window w as (partition by x order by no rows unbounded preceding)"""


DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d') as day"
MONTH_SQL = "strftime(o_orderdate, '%m') as month"


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))


# --- counts ------------------------------------------------------------------


@query("a1_crosstab", _matrix_sql("year", PRIORITIES))
def a1_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.crosstab(orders(spark, sf_dir), "year", "o_orderpriority")


# Suppliers are as many as the data has; the SQL lists every block's names and counts in their order.
BLOCK_WIDTH = 64


@query(
    "a1_crosstab_blocks",
    f"""with pairs as (select l_returnflag, l_suppkey, count(*) as n from lineitem
                      where l_returnflag is not null and l_suppkey is not null group by all),
             names as (select l_suppkey, (row_number() over (order by l_suppkey) - 1) // {BLOCK_WIDTH} as block
                       from (select distinct l_suppkey from pairs)),
             keys as (select distinct l_returnflag from pairs)
        select l_returnflag, cast(block as integer) as block,
               string_agg(cast(l_suppkey as varchar), ',' order by l_suppkey) as names,
               string_agg(cast(coalesce(n, 0) as varchar), ',' order by l_suppkey) as counts
        from keys cross join names left join pairs using (l_returnflag, l_suppkey) group by all""",
)
def a1_crosstab_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrices.crosstab_blocks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", BLOCK_WIDTH)
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("names", "counts")]
    return found.select("l_returnflag", "block", *listed)


@query("a2_crosstab_named", _matrix_sql("year", NAMED))
def a2_crosstab_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.crosstab(orders(spark, sf_dir), "year", "o_orderpriority", NAMED)


@query("a3_trend", _matrix_sql(DAY_SQL, NAMED, True))
def a3_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.trend(_by_day(spark, sf_dir), "day", "o_orderpriority", NAMED)


@query(
    "a4_outcome_by",
    """select l_suppkey, count(*) filter (l_returnflag <> 'R') as not_arrested,
              count(*) filter (l_returnflag = 'R') as arrested
       from lineitem group by 1""",
)
def a4_outcome_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return counts.outcome_by(flagged, "l_suppkey", "returned")


@query(
    "a5_outcome_by_named",
    f"""select o_orderpriority, count(*) filter (not filled) as not_arrested, count(*) filter (filled) as arrested
        from ({ORDERS_SQL}) where o_orderpriority in ('5-LOW', '1-URGENT', '0-NONE', '3-MEDIUM') group by 1""",
)
def a5_outcome_by_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.outcome_by(orders(spark, sf_dir), "o_orderpriority", "filled", keys_in=NAMED)


@query(
    "a6_group_sizes",
    "select l_suppkey, l_returnflag = 'R' as returned, count(*) as n from lineitem group by 1, 2",
)
def a6_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return counts.group_sizes(flagged, ["l_suppkey", "returned"])


@query("a7_seasonality", _matrix_sql(MONTH_SQL, NAMED, True))
def a7_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.seasonality(orders(spark, sf_dir), "date_text", "o_orderpriority", NAMED)


VALUE_COLUMNS = ["o_orderpriority", "o_orderstatus", "o_custkey", "o_totalprice"]


@query(
    "a8_value_counts",
    " union all ".join(
        f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n from orders group by 2"
        for c in VALUE_COLUMNS
    ),
)
def a8_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.value_counts(table(spark, sf_dir, "orders"), VALUE_COLUMNS)


@query(
    "a9_describe_features",
    " union all ".join(
        f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std from lineitem"
        for c in MEASURES
    ),
)
def a9_describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.describe_features(table(spark, sf_dir, "lineitem"), MEASURES)
    return found.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "a10_correlations",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i:]
    ),
)
def a10_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.correlations(table(spark, sf_dir, "lineitem"), MEASURES)
    return found.select("a", "b", F.round("r", 6).alias("r"))


@query(
    "a11_token_counts",
    f"""select token, count(*) as n from (
          select unnest({tokens_sql('text')}) as token from documents
          union all select unnest({tokens_sql('source')}) from documents) group by 1""",
)
def a11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), ["text", "source"])


@query("a12_mean_metric", MEAN_METRICS_SQL)
def a12_mean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_metrics(spark, sf_dir)


# --- chart tables ------------------------------------------------------------


@query("c1_stacked_bars", _stack_sql(_long_sql("year", PRIORITIES)))
def c1_stacked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.stacked_bars(counts.crosstab(orders(spark, sf_dir), "year", "o_orderpriority"), "year")


@query("c2_stacked_bars_named", _stack_sql(_long_sql("year", NAMED)))
def c2_stacked_bars_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = counts.crosstab(orders(spark, sf_dir), "year", "o_orderpriority", NAMED)
    return charts.stacked_bars(matrix, "year")


@query("c3_trend_lines", f"select x, series, value from ({_long_sql(DAY_SQL.removesuffix(' as day'), NAMED, True)})")
def c3_trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.lines(counts.trend(_by_day(spark, sf_dir), "day", "o_orderpriority", NAMED), "day")


@query(
    "c4_outcome_bars",
    _stack_sql(
        " union all ".join(
            f"""select o_orderpriority as x, {no} as no, '{name}' as series, count(*) filter ({test}) as value
                from ({ORDERS_SQL}) where o_orderpriority in ('5-LOW', '1-URGENT', '0-NONE', '3-MEDIUM') group by 1"""
            for no, name, test in [(0, "Not Arrested", "not filled"), (1, "Arrested", "filled")]
        )
    ),
)
def c4_outcome_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = counts.outcome_by(orders(spark, sf_dir), "o_orderpriority", "filled", keys_in=NAMED)
    return charts.outcome_bars(outcomes, "o_orderpriority")


@query(
    "c5_month_lines",
    f"""select x, strftime(make_date(2000, cast(x as integer), 1), '%b') as label, series, value
        from ({_long_sql(MONTH_SQL.removesuffix(' as month'), NAMED, True)})""",
)
def c5_month_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.month_lines(counts.seasonality(orders(spark, sf_dir), "date_text", "o_orderpriority", NAMED))


@query(
    "c6_density_grid",
    """select cast(floor(l_quantity / 5) as bigint) as cell_x, cast(floor(l_extendedprice / 2500) as bigint) as cell_y,
              floor(l_quantity / 5) * 5.0 as x0, floor(l_extendedprice / 2500) * 2500.0 as y0, count(*) as n
       from lineitem group by 1, 2, 3, 4""",
)
def c6_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.density_grid(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 2500.0)


@query(
    "c7_confusion_heatmap",
    f"""select case label when 0 then 'Not Arrested' else 'Arrested' end as true_label,
               count(*) filter (score <= 0.5) as "Predicted Not Arrested",
               count(*) filter (score > 0.5) as "Predicted Arrested"
        from ({SCORED_SQL}) group by 1""",
)
def c7_confusion_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged_rows = scored(spark, sf_dir).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    confusion = scores.confusion_matrix(scores.prediction_counts(judged_rows), [0, 1])
    return charts.confusion_heatmap(confusion, {0: "Not Arrested", 1: "Arrested"})


@query(
    "c1_stacked_counts",
    """select x, series, value, cast(sum(value) over w - value as bigint) as y0, cast(sum(value) over w as bigint) as y1
       from (select l_returnflag as x, l_partkey as series, count(*) as value from lineitem group by all)
       where x is not null and series is not null
       window w as (partition by x order by series rows unbounded preceding)""",
)
def c1_stacked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = counts.group_sizes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_partkey"])
    return matrices.stacked_counts(sizes, "l_returnflag", "l_partkey")


ROC_SQL = f"""
    with s as (select score, sum(label) as pos, sum(1 - label) as neg from ({SCORED_SQL}) group by 1),
         r as (select *, sum(pos) over w as tp, sum(neg) over w as fp from s
               window w as (order by score desc rows unbounded preceding)),
         p as (select fp / (select max(fp) from r) as fpr, tp / (select max(tp) from r) as tpr,
                      score as threshold from r
               union all select 0, 0, null),
         a as (select sum(neg * (tp - pos / 2)) / (max(tp) * max(fp)) as auc from r)"""


@query(
    "c8_roc_chart",
    ROC_SQL
    + """
    select round(fpr, 9) as fpr, round(tpr, 9) as tpr, round(fpr, 9) as diagonal,
           printf('ROC curve (area = %.2f)', auc) as legend
    from p, a""",
)
def c8_roc_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scores.ranked_scores(scored(spark, sf_dir))
    chart = charts.roc_chart(scores.curve(ranked), scores.area(ranked).first()["auc"])
    return chart.select(*[F.round(c, 9).alias(c) for c in ["fpr", "tpr", "diagonal"]], "legend")


# --- rankings ----------------------------------------------------------------


@query(
    "k1_top_groups",
    """select l_suppkey, l_returnflag = 'R' as returned, count(*) as n from lineitem group by 1, 2
       order by n desc, l_suppkey, returned limit 15""",
)
def k1_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return ranking.top_groups(flagged, ["l_suppkey", "returned"], 15)


@query(
    "k2_frequency_ranks",
    " union all ".join(
        f"""select '{c}' as "column", value, n, row_number() over (order by n desc, value) - 1 as rank
            from (select cast({c} as varchar) as value, count(*) as n from orders group by 1)"""
        for c in VALUE_COLUMNS
    ),
)
def k2_frequency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.frequency_ranks(table(spark, sf_dir, "orders"), VALUE_COLUMNS)


@query("k3_best_row", f"select * from ({MEAN_METRICS_SQL}) order by avg_metric desc, seq limit 1")
def k3_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_row(mean_metrics(spark, sf_dir), "avg_metric", "seq")


@query(
    "k4_sorted_axes",
    f"""select cast(row_number() over (order by day) - 1 as bigint) as place, * from (
        {_matrix_sql(DAY_SQL, PRIORITIES)})""",
)
def k4_sorted_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The matrix comes sorted; its row numbers are the places of a sorted axis.
    from blotter.operators.positions import with_position

    matrix = counts.crosstab(_by_day(spark, sf_dir), "day", "o_orderpriority")
    return with_position(matrix, [F.col("day")], "place")


# --- the report job ----------------------------------------------------------

TYPES = ["CLICK", "ERROR", "VIEW", "THEFT"]


def _report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return incident_reports(incidents(spark, sf_dir), TYPES, ["STREET", "AREA 1", "AREA 2"])[name]


@query(
    "report_types_by_year",
    f"""select cast("Year" as integer) as "Year", """
    + ", ".join(f"""count(*) filter ("Primary Type" = '{t}') as "{t}\"""" for t in TYPES)
    + f" from ({INCIDENTS_SQL}) group by 1",
)
def report_types_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "named_types_by_year")


@query(
    "report_largest_outcome_groups",
    f"""select "Location Description", cast("Arrest" as boolean) as "Arrest", count(*) as n
        from ({INCIDENTS_SQL}) group by 1, 2 order by n desc, 1, 2 limit 15""",
)
def report_largest_outcome_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "largest_outcome_groups")
