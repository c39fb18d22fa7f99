"""Sources, sinks, columns and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import month_of, tokenize
from blotter.operators import columns, filters
from blotter.operators.counts import crosstab, group_sizes
from blotter.operators.scaling import assemble
from blotter.plans.tables import clean
from blotter.queries.bindings import INCIDENTS_SQL, incidents, orders
from blotter.queries.registry import query, table
from blotter.sources import (
    export_batches,
    read_incidents,
    read_table,
    with_batches,
    write_results,
    write_table,
)
from blotter.staging import fresh_path

# --- sources and sinks -------------------------------------------------------


@query("s1_read_incidents", INCIDENTS_SQL)
def s1_read_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "incidents-csv")
    write_table(incidents(spark, sf_dir), path)
    return read_incidents(spark, path)


@query("s1_read_parquet", "select * from nation")
def s1_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_incidents(spark, f"{sf_dir}/nation.parquet")


@query(
    "s2_read_table",
    """
    select cast(o_orderkey as integer) as o_orderkey, cast(o_custkey as integer) as o_custkey,
           o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate,
           o_orderpriority
    from orders""",
)
def s2_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders-csv")
    write_table(table(spark, sf_dir, "orders"), path)
    inferred = read_table(spark, path)
    # A timestamp in the file is inferred as one; the keys are inferred as int where they fit.
    return inferred.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "s3_write_table",
    f"""
    select p_partkey, p_name, p_retailprice,
           '["' || replace(p_name, ' ', '","') || '"]' as words
    from part""",
)
def s3_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "parts-csv")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    write_table(parts.withColumn("words", tokenize(F.col("p_name"))), path)
    return read_incidents(
        spark, path, "p_partkey long, p_name string, p_retailprice double, words string"
    )


@query(
    "s3_write_texts",
    "select doc_id, text, lang, source from documents",
)
def s3_write_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "texts-csv")
    write_table(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    return read_incidents(
        spark, path, "doc_id long, text string, lang string, source string", multiline=True
    )


@query(
    "s4_write_results",
    "select o_orderpriority, cast(count(*) as integer) as n from orders group by 1",
)
def s4_write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "results-csv")
    write_results(group_sizes(table(spark, sf_dir, "orders"), ["o_orderpriority"]), path)
    return read_incidents(spark, path, "o_orderpriority string, n int")


BATCH_SIZE = 4000


@query(
    "s5_export_batches",
    f"""
    select cast(floor((row_number() over (order by o_orderkey) - 1) / {BATCH_SIZE}) + 1 as integer) as batch,
           row_number() over (order by o_orderkey) - 1 as position,
           o_orderkey, o_totalprice, o_orderpriority
    from orders""",
)
def s5_export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "batches")
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    export_batches(spark, source, path, ["o_orderkey"], BATCH_SIZE, index=True)
    schema = "index long, o_orderkey long, o_totalprice double, o_orderpriority string, Batch int"
    return read_incidents(spark, path, schema).withColumnsRenamed({"Batch": "batch", "index": "position"})


@query(
    "s5_source_order",
    f"""
    select cast(floor((row_number() over (order by o_totalprice desc, o_orderkey) - 1) / {BATCH_SIZE}) + 1 as integer) as batch,
           row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position, o_orderkey, o_totalprice
    from orders""",
)
def s5_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are sorted by price are cut as they stand, whatever their keys."""
    source, path = fresh_path(spark, "by-price"), fresh_path(spark, "batches")
    write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), source)
    export_batches(spark, source, path, size=BATCH_SIZE, index=True)
    read = read_incidents(spark, path, "index long, o_orderkey long, o_totalprice double, Batch int")
    return read.withColumnsRenamed({"Batch": "batch", "index": "position"})


@query(
    "s5_batch_numbers",
    """
    select cast(floor((row_number() over (order by all_of_it) - 1) / 30000) + 1 as bigint) as batch,
           l_orderkey, l_linenumber, l_partkey
    from (select *, (l_orderkey, l_linenumber, l_partkey) as all_of_it from lineitem)""",
)
def s5_batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return with_batches(table(spark, sf_dir, "lineitem").select(*keys), keys, name="batch").drop("__position")


# --- columns -----------------------------------------------------------------


@query(
    "p1_drop_columns",
    "select event_id, ts, user_id, event_type from events",
)
def p1_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.drop_columns(table(spark, sf_dir, "events"), ["value", "props"])


@query(
    "p1b_drop_identifiers",
    """select o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""",
)
def p1b_drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.drop_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query("p1c_drop_text", "select p_partkey, p_size, p_retailprice from part")
def p1c_drop_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.drop_columns(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("p2_select_columns", "select l_orderkey, l_quantity, l_returnflag from lineitem")
def p2_select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.select_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"])


@query(
    "p2b_select_features_and_label",
    """select round(l_quantity, 6) as f0, round(l_discount, 6) as f1, l_returnflag as label from lineitem""",
)
def p2b_select_features_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = assemble(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    chosen = columns.select_columns(
        featured.withColumnRenamed("l_returnflag", "label"), ["features", "label"]
    )
    unpacked = columns.vector_elements(chosen, "features", ["f0", "f1"])
    return unpacked.select(F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"), "label")


@query(
    "p3_index_names",
    f"""select "Primary Type" as i_primary_type, "Location Description" as i_location_description,
               "IUCR" as i_iucr from ({INCIDENTS_SQL})""",
)
def p3_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.rename_indexed(
        incidents(spark, sf_dir), ["Primary Type", "Location Description", "IUCR"]
    )


@query(
    "p4_cast_columns",
    """select o_orderkey, cast(year as double) as year, cast(filled as double) as filled, o_orderpriority
       from (select *, year(o_orderdate) as year, o_orderstatus = 'F' as filled from orders)""",
)
def p4_cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = orders(spark, sf_dir).select("o_orderkey", "year", "filled", "o_orderpriority")
    return columns.cast_columns(chosen, ["year", "filled"], "double")


@query(
    "p4_canonical_types",
    f"""select "ID", cast("Arrest" as boolean) as "Arrest", cast("District" as integer) as "District",
               cast("Year" as integer) as "Year", strptime("Date", '%m/%d/%Y %I:%M:%S %p') as occurred_at,
               "FBI Code"
        from ({INCIDENTS_SQL})""",
)
def p4_canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = columns.to_canonical(incidents(spark, sf_dir))
    return typed.select("ID", "Arrest", "District", "Year", "occurred_at", "FBI Code")


@query(
    "p5_vector_elements",
    """select vec_id, round(cast(embedding[1] as double), 6) as pca1,
              round(cast(embedding[2] as double), 6) as pca2 from embeddings""",
)
def p5_vector_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    unpacked = columns.vector_elements(vectors, "v", ["pca1", "pca2"])
    return unpacked.select("vec_id", F.round("pca1", 6).alias("pca1"), F.round("pca2", 6).alias("pca2"))


@query("p6_two_columns", "select l_quantity as pca1, l_discount as pca2 from lineitem")
def p6_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "pca1", "l_discount": "pca2"})
    return columns.select_columns(scores, ["pca1", "pca2"])


@query(
    "p7_add_column",
    """select o_orderkey, strftime(o_orderdate, '%m') as "Month" from orders""",
)
def p7_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = columns.add_column(orders(spark, sf_dir), "Month", month_of(F.col("date_text")))
    return added.select("o_orderkey", "Month")


# DuckDB's names of the types in these tables, as Spark calls them.
TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT[]": "array<float>"}


@query(
    "p8_schema",
    " union all ".join(
        f"""select '{t}' as "table", cast(row_number() over () - 1 as integer) as position, column_name as name, """
        + "case column_type "
        + " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_NAMES.items())
        + f" end as type from (describe select * from {t})"
        for t in ("customer", "documents", "embeddings")
    ),
)
def p8_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of the columns of some tables."""
    listed = [
        columns.schema_rows(table(spark, sf_dir, t)).select(F.lit(t).alias("table"), "position", "name", "type")
        for t in ("customer", "documents", "embeddings")
    ]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


@query(
    "p4_text_flags",
    """select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1.0 when l_returnflag = 'A' then 0.0 end::double as flag,
              cast(l_quantity as double) as quantity
       from lineitem""",
)
def p4_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRUE and FALSE as text, and numbers as text, made numeric."""
    flag = F.when(F.col("l_returnflag") == "R", "TRUE").when(F.col("l_returnflag") == "A", "FALSE")
    written = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", flag.alias("flag"), F.col("l_quantity").cast("string").alias("quantity")
    )
    return columns.cast_columns(written, ["flag", "quantity"])


@query("p8_peek", "select * from orders order by o_totalprice, o_orderkey limit 5")
def p8_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.peek(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 5)


# --- filters -----------------------------------------------------------------


@query(
    "f1_drop_incomplete",
    """
    select event_id, event_type, reading from (
      select event_id, case when event_type = 'error' then 'N/A' else event_type end as event_type,
             case when value >= 100 then value end as reading
      from events)
    where event_type not in ('', 'N/A', 'NA', 'NaN', 'null') and reading is not null""",
)
def f1_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    gaps = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "N/A").otherwise(kind).alias("event_type"),
        F.when(value >= 200, value).when(value >= 100, value).when(value >= 50, float("nan")).alias("reading"),
    )
    return filters.drop_incomplete(gaps, ["", "N/A", "NA", "NaN", "null"])


@query(
    "f1_clean",
    f"""select * from ({INCIDENTS_SQL}) where "Location Description" <> 'STREET'""",
)
def f1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Gaps in a column that cleaning drops cost no row; a null token elsewhere does.
    place = F.col("Location Description")
    raw = (
        incidents(spark, sf_dir)
        .withColumn("Beat", F.when(F.col("Primary Type") != "VIEW", "b"))
        .withColumn("Location Description", F.when(place == "STREET", "null").otherwise(place))
    )
    return clean(raw)


@query(
    "f2_filter_in",
    "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM')",
)
def f2_filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.filter_in(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-low"])
    return chosen.select("o_orderkey", "o_orderpriority")


@query(
    "f3_named_categories",
    """
    select cast(year(o_orderdate) as integer) as year,
           count(*) filter (o_orderpriority = '5-LOW') as "5-LOW",
           count(*) filter (o_orderpriority = '2-HIGH') as "2-HIGH",
           cast(0 as bigint) as "NOT THERE"
    from orders group by 1""",
)
def f3_named_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab(orders(spark, sf_dir), "year", "o_orderpriority", ["5-LOW", "2-HIGH", "NOT THERE"])


@query(
    "f4_null_keys_vanish",
    """
    select nullif(o_orderpriority, '5-LOW') as o_orderpriority, nullif(o_orderstatus, 'P') as o_orderstatus,
           count(*) as n
    from orders where o_orderpriority <> '5-LOW' and o_orderstatus <> 'P' group by 1, 2""",
)
def f4_null_keys_vanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
    )
    return group_sizes(gaps, ["o_orderpriority", "o_orderstatus"])
