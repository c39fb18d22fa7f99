"""Scalar functions, words and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import as_percentage, hour_of, month_of, tokenize, total, zero_if_null
from blotter.operators.counts import group_sizes
from blotter.operators.vocabulary import encode_columns, fit_vocabulary, texts_to_sequences
from blotter.plans.tables import encode
from blotter.queries.bindings import INCIDENTS_SQL, incidents, orders, tokens_sql
from blotter.queries.registry import SQL, query, table


@query(
    "d1_hour_of",
    "select event_id, case when event_type <> 'error' then cast(hour(ts) as integer) end as hour from events",
)
def d1_hour_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two-digit hours, one-digit hours and text that is no time.
    written = (
        F.when(F.col("event_type") == "error", "some time in May")
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "MM/dd/yyyy h:mm:ss a"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"))
    )
    return table(spark, sf_dir, "events").select("event_id", hour_of(written).alias("hour"))


@query("d2_month_of", "select o_orderkey, strftime(o_orderdate, '%m') as month from orders")
def d2_month_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", month_of(F.col("date_text")).alias("month"))


@query(
    "d3_year_key",
    "select cast(year(o_orderdate) as integer) as year, count(*) as n from orders group by 1",
)
def d3_year_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(orders(spark, sf_dir), ["year"])


@query(
    "t1_tokenize",
    f"""select doc_id, len(tokens) as n_tokens, array_to_string(tokens, ' ') as tokens
        from (select doc_id, {tokens_sql('text')} as tokens from documents)""",
)
def t1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return words.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("tokens")
    )


@query(
    "m1_total",
    """select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total
       from embeddings""",
)
def m1_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(values), 6).alias("total"))


@query(
    "m2_percentage",
    """select l_suppkey, round(100 * avg(cast(l_returnflag = 'R' as double)), 2) as percent_returned
       from lineitem group by 1""",
)
def m2_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("l_returnflag") == "R").cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(as_percentage(share).alias("percent_returned"))


@query(
    "m3_zero_if_null",
    "select event_id, case when event_type = 'error' then 0 else user_id end as user_id from events",
)
def m3_zero_if_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_type") != "error", F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", zero_if_null(known).alias("user_id"))


def _vocabulary_sql(texts: list[tuple[str, str]]) -> str:
    """``(token, n, id)`` over text columns, given as (column, relation)."""
    words = " union all ".join(f"select unnest({tokens_sql(c)}) as token from {r}" for c, r in texts)
    return f"""select token, n, cast(row_number() over (order by n desc, token) as integer) as id
               from (select token, count(*) as n from ({words}) group by 1)"""


DOCUMENT_WORDS = _vocabulary_sql([("text", "documents"), ("source", "documents")])


@query("x10_fit_vocabulary", DOCUMENT_WORDS)
def x10_fit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocabulary(table(spark, sf_dir, "documents"), ["text", "source"]).words


def _sequences_sql(key: str, text: str, relation: str) -> str:
    """``(key, seq)``: word numbers of a text from relation ``v``, in order, as text."""
    return f"""
      select s.{key}, coalesce(string_agg(cast(v.id as varchar), ' ' order by s.at), '') as seq
      from (select {key}, unnest(tokens) as token, generate_subscripts(tokens, 1) as at
            from (select {key}, {tokens_sql(text)} as tokens from {relation})) s
      left join v on s.token = v.token group by 1"""


@query(
    "x11_texts_to_sequences",
    f"""with v as ({DOCUMENT_WORDS} qualify n >= 3),
             a as ({_sequences_sql('doc_id', 'text', 'documents')}),
             b as ({_sequences_sql('doc_id', 'source', 'documents')})
        select d.doc_id, coalesce(a.seq, '') as text_seq, coalesce(b.seq, '') as source_seq
        from documents d left join a on a.doc_id = d.doc_id left join b on b.doc_id = d.doc_id""",
)
def x11_texts_to_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Words met only once or twice are outside the vocabulary here, so they are left out.
    vocabulary = fit_vocabulary(docs, ["text", "source"], min_count=3)
    found = texts_to_sequences(docs, "doc_id", {"text": "text_seq", "source": "source_seq"}, vocabulary)
    return found.select("doc_id", *[F.concat_ws(" ", c).alias(c) for c in ["text_seq", "source_seq"]])


@query("x11_texts_to_sequences_tail", SQL["x11_texts_to_sequences"])
def x11_texts_to_sequences_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a hundred words broadcast; the others are looked up by shuffle."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = fit_vocabulary(docs, ["text", "source"], min_count=3, head_entries=100)
    found = texts_to_sequences(docs, "doc_id", {"text": "text_seq", "source": "source_seq"}, vocabulary)
    return found.select("doc_id", *[F.concat_ws(" ", c).alias(c) for c in ["text_seq", "source_seq"]])


@query(
    "x11_encode_columns",
    f"""with v as ({_vocabulary_sql([('p_name', 'part'), ('p_type', 'part')])}),
             a as ({_sequences_sql('p_partkey', 'p_name', 'part')}),
             b as ({_sequences_sql('p_partkey', 'p_type', 'part')})
        select p_partkey, p_brand, a.seq as name_seq, b.seq as type_seq
        from part join a using (p_partkey) join b using (p_partkey)""",
)
def x11_encode_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    vocabulary = fit_vocabulary(parts, ["p_name", "p_type"])
    encoded = encode_columns(parts, {"p_name": "name_seq", "p_type": "type_seq"}, vocabulary)
    return encoded.select(
        "p_partkey", "p_brand", *[F.concat_ws(" ", c).alias(c) for c in ["name_seq", "type_seq"]]
    )


# Part types under a key that repeats and is partly missing, some without a type.
LOOSE_SQL = """select case when p_partkey % 3 <> 0 then p_size end as k, p_partkey,
                      case when p_partkey % 5 <> 0 then p_type end as p_type from part"""
LOOSE_ENCODED_SQL = f"""
    with l as ({LOOSE_SQL}), v as ({_vocabulary_sql([('p_type', 'l')])}), a as ({_sequences_sql('p_partkey', 'p_type', 'l')})
    select l.k, l.p_partkey, coalesce(a.seq, '') as type_seq from l left join a using (p_partkey)"""


def _loose_encoded(spark: SparkSession, sf_dir: str, **limit: int) -> DataFrame:
    loose = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("k"),
        "p_partkey",
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("p_type"),
    )
    encoded = encode_columns(loose, {"p_type": "type_seq"}, fit_vocabulary(loose, ["p_type"]), **limit)
    return encoded.select("k", "p_partkey", F.concat_ws(" ", "type_seq").alias("type_seq"))


@query("x11_encode_loose_keys", LOOSE_ENCODED_SQL)
def x11_encode_loose_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose_encoded(spark, sf_dir)


@query("x11_encode_without_broadcast", LOOSE_ENCODED_SQL)
def x11_encode_without_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose_encoded(spark, sf_dir, broadcast_bytes=0)


@query(
    "encode_incidents",
    f"""with i as ({INCIDENTS_SQL}),
             v as ({_vocabulary_sql([('"Location Description"', 'i'), ('"Primary Type"', 'i')])}),
             a as ({_sequences_sql('"ID"', '"Location Description"', 'i')}),
             b as ({_sequences_sql('"ID"', '"Primary Type"', 'i')})
        select i."ID", i."Block", a.seq as "Loc_Descr_Int", b.seq as "Prim_Type_Int"
        from i join a on a."ID" = i."ID" join b on b."ID" = i."ID" """,
)
def encode_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(incidents(spark, sf_dir))
    return encoded.select(
        "ID", "Block", *[F.concat_ws(" ", c).alias(c) for c in ["Loc_Descr_Int", "Prim_Type_Int"]]
    )
