import random

from llm_cases import documents, nothing
from pyspark.sql import functions as F

from blotter.llm.language import held_out, identify, keep_known, train

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["schu", "ung", "zer", "ö"], "cc": ["eau", "qu", "é", "ion"]}


def corpus(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40)))
        rows.append((i, text, lang if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    told = identify(docs, model, [docs["lang"], held_out(docs["doc_id"]).alias("held_out")]).filter("held_out and lang is not null").collect()
    assert len(told) > 50 and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def test_awkward_rows(spark):
    docs = documents(spark)
    model = train(corpus(spark))
    told = {r.doc_id: r for r in identify(docs, model, [docs["doc_id"]]).collect()}
    assert all(told[i].lang_pred == "und" and told[i].score == 0 for i in (30, 31, 32, 33, None))
    assert told[39].lang_pred in model.languages
    assert identify(docs, train(nothing(spark)), [docs["doc_id"]]).filter("lang_pred <> 'und'").count() == 0
    kept = keep_known(docs)
    assert kept.columns == docs.columns and kept.filter(F.col("text").isNull()).count() == 0
    assert keep_known(nothing(spark)).count() == 0


def test_only_the_text_decides(spark):
    docs = corpus(spark)
    model = train(docs)
    shuffled = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1000)
    one = sorted((r.text, r.lang_pred, r.score) for r in identify(docs, model, [docs["text"]]).collect())
    two = sorted((r.text, r.lang_pred, r.score) for r in identify(shuffled, model, [shuffled["text"]]).collect())
    assert one == two


def test_nothing_learned_rejects_no_text_with_letters(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, None), (3, "123", None), (4, "слова", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in keep_known(docs).collect()) == [1, 4]
