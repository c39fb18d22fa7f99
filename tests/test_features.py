import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blotter.functions.text import tokenize
from blotter.operators import indexing, scaling, skew, splits, vocabulary
from blotter.operators.columns import cast_columns, vector_elements
from blotter.operators.indexing import FrequencyIndexer, decode
from blotter.operators.moments import Moments
from blotter.operators.positions import with_position, with_running_totals
from blotter.plans.projection import project


def skewed(spark, n=4000):
    """A third of the rows share one value; the others have few rows each."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("key"), F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (i % 701).cast("string"))).alias("v")
    )


def expected_ranks(values):
    counted = Counter(values)
    return {v: r for r, v in enumerate(sorted(counted, key=lambda v: (-counted[v], v)))}


@pytest.fixture(params=["head", "tail"])
def sizes(request, monkeypatch):
    """All lookups by broadcast, and most of them by shuffle."""
    if request.param == "tail":
        monkeypatch.setattr(indexing, "HEAD_ENTRIES", 3)
        monkeypatch.setattr(vocabulary.fit_vocabulary, "__defaults__", (1, 3))
    return request.param


def test_positions_and_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(5)
    placed = with_position(df, [F.desc("k")]).collect()
    assert all(r.position == 999 - r.k for r in placed) and len(placed) == 1000
    running = {r.k: r.total for r in with_running_totals(df, [F.col("k")], {"total": F.col("w")}).collect()}
    weights = {r.k: r.w for r in df.collect()}
    upto = 0
    for k in range(1000):
        upto += weights[k]
        assert running[k] == upto


def test_positions_restart_in_groups(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id"))
    placed = with_position(df, [F.col("g"), F.col("id")], group="g").collect()
    assert all(r.position == r.id // 3 for r in placed)


def test_frequency_index(spark, sizes):
    df = skewed(spark)
    expected = expected_ranks([r.v for r in df.collect()])
    model = FrequencyIndexer(["v"], ["i_v"]).fit(df)
    assert (model.sizes["v"].values <= model.sizes["v"].head) == (sizes == "head")
    found = model.transform(df).collect()
    assert len(found) == 4000 and all(r.i_v == expected[r.v] for r in found)


def test_only_narrow_triples_are_shuffled_for_rare_values(spark):
    df = skewed(spark).withColumn("w", F.concat(F.lit("w"), F.col("key") % 900)).withColumn("wide", F.repeat(F.lit("x"), 100))
    model = FrequencyIndexer(["v", "w"], ["i_v", "i_w"], head_entries=4).fit(df)
    assert (model.sizes["v"].head, model.sizes["w"].head) == (2, 2)
    found = model.transform(df)
    for name in ("v", "w"):
        ranks = expected_ranks([r[name] for r in df.select(name).collect()])
        assert all(r[f"i_{name}"] == ranks[r[name]] for r in found.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    # One exchange of triples and one of the index, then the triples and the open rows by row, however many columns.
    assert len(keys) == 4 and sum("key" in k for k in keys) == 2 and sum("__row" in k for k in keys) == 2


def test_one_budget_for_all_heads():
    sizes = indexing.plan_heads({"a": 2, "b": 1000, "c": 10}, 100)
    assert {n: s.head for n, s in sizes.items()} == {"a": 2, "c": 10, "b": 88}
    assert sum(s.head for s in indexing.plan_heads({"a": 90, "b": 90}, 100).values()) == 100


def test_unseen_values(spark, sizes):
    df = skewed(spark)
    unseen = spark.createDataFrame([(1, "hot"), (2, "new"), (3, None)], "key long, v string")
    n = len(expected_ranks([r.v for r in df.collect()]))
    keep = FrequencyIndexer(["v"], ["i"], "keep").fit(df).transform(unseen).orderBy("key").collect()
    assert [r.i for r in keep] == [0.0, float(n), float(n)]
    skip = FrequencyIndexer(["v"], ["i"], "skip").fit(df).transform(unseen).collect()
    assert [(r.key, r.i) for r in skip] == [(1, 0.0)]
    with pytest.raises(PySparkException, match="no index in v for new"):
        FrequencyIndexer(["v"], ["i"]).fit(df).transform(unseen.filter("key = 2")).collect()
    with pytest.raises(ValueError):
        FrequencyIndexer(["v"], handleInvalid="ignore")


def test_decoding(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "v string")
    model = FrequencyIndexer(["v"], ["i"]).fit(df)
    assert model.labels("v") == ["b", "a"]
    back = decode(model.transform(df), "i", model.labels("v"), "w").collect()
    assert all(r.v == r.w for r in back)


def test_vocabulary_and_sequences(spark, sizes):
    texts = [(1, "the cat, the dog", "pets"), (2, "dog's  life", None), (3, "", "The Cat"), (4, None, " . ")]
    df = spark.createDataFrame(texts, "key int, a string, b string")
    words = ["the", "cat", "the", "dog", "dog's", "life", "the", "cat", "pets"]
    ids = {w: r + 1 for w, r in expected_ranks(words).items()}
    fitted = vocabulary.fit_vocabulary(df, ["a", "b"])
    assert {r.token: r.id for r in fitted.words.collect()} == ids
    found = vocabulary.texts_to_sequences(df, "key", {"a": "x", "b": "y"}, fitted).orderBy("key").collect()
    as_ids = lambda *w: [ids[v] for v in w]
    assert [(r.x, r.y) for r in found] == [
        (as_ids("the", "cat", "the", "dog"), as_ids("pets")),
        (as_ids("dog's", "life"), []),
        ([], as_ids("the", "cat")),
        ([], []),
    ]


@pytest.mark.parametrize("head", [0, 2, 7, 500])
def test_words_of_a_text_stay_together(spark, head):
    """Before, every word became a row, which was sorted back into its text; now words leave it at most once a text."""
    rng = random.Random(head)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "x-y"]
    text = [" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(60))) for _ in range(90)]
    rows = [(i if i else None, t if i % 7 else None, text[-i] if i % 5 else "") for i, t in enumerate(text)] + [(90, "nowhere w0", "w0 " * 3000)]
    df = spark.createDataFrame(rows, "k long, a string, b string").repartition(5)
    fitted = vocabulary.fit_vocabulary(df.filter("k is null or k < 90"), ["a", "b"], min_count=4, head_entries=head)
    numbers = {r["token"]: r["id"] for r in fitted.words.collect()}
    assert min(len(numbers), head) == fitted.size.head and "nowhere" not in numbers
    cut = df.select("k", tokenize(F.col("a")).alias("a"), tokenize(F.col("b")).alias("b")).filter("k is not null").collect()
    expected = {r["k"]: tuple([numbers[w] for w in t or [] if w in numbers] for t in (r["a"], r["b"])) for r in cut}
    found = vocabulary.texts_to_sequences(df, "k", {"a": "x", "b": "y"}, fitted)
    assert {r["k"]: (r["x"], r["y"]) for r in found.collect()} == expected and found.count() == len(rows) - 1
    assert found.schema["x"].dataType.simpleString() == "array<int>"
    if head == 500:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("limit", [vocabulary.BROADCAST_BYTES, 0])
def test_encode_columns_both_ways(spark, limit):
    rows = [(1, "x y"), (1, "y"), (None, "y z"), (None, None), (4, "x y")]
    df = spark.createDataFrame(rows, "key int, a string")
    fitted = vocabulary.fit_vocabulary(df, ["a"])
    found = vocabulary.encode_columns(df, {"a": "seq"}, fitted, broadcast_bytes=limit).collect()
    ids = {"y": 1, "x": 2, "z": 3}
    assert sorted(map(repr, [(r.key, r.a, r.seq) for r in found])) == sorted(
        repr((k, a, [ids[w] for w in (a or "").split()])) for k, a in rows
    )


def test_casting_keeps_order_and_other_columns(spark):
    df = spark.createDataFrame([(True, "x", 2)], "a boolean, b string, c int")
    assert cast_columns(df, ["a", "c"]).dtypes == [("a", "double"), ("b", "string"), ("c", "double")]


def test_truth_values_are_not_parsed_as_numbers(spark):
    """A failing cast to a number costs an exception for every row; before, it came first."""
    texts = ["TRUE", "false", "0", "1", " 1 ", "1.5", "-2", "1e3", "y", None]
    found = cast_columns(spark.createDataFrame([(t,) for t in texts], "x string"), ["x"])
    assert [r["x"] for r in found.collect()] == [1.0, 0.0, 0.0, 1.0, 1.0, 1.5, -2.0, 1000.0, 1.0, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("as boolean") < plan.index("x#") + 200 and "coalesce(cast(cast(" in plan.replace("try_", "")


def test_standardize_uses_the_sample_deviation(spark):
    df = scaling.assemble(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, y double"), ["x", "y"])
    found = vector_elements(scaling.standardize(df), "scaled_features", ["zx", "zy"]).orderBy("x").collect()
    sd = np.std([1, 2, 6], ddof=1)
    assert [round(r.zx, 9) for r in found] == [round((v - 3) / sd, 9) for v in (1, 2, 6)]
    assert [r.zy for r in found] == [0.0, 0.0, 0.0]


def test_population_scaler(spark):
    df = scaling.assemble(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double"), ["x", "y"])
    scaler = scaling.PopulationScaler.fit(df, "features")
    assert scaler.means == [2.0, 5.0] and scaler.deviations == [1.0, 1.0]
    other = scaling.assemble(spark.createDataFrame([(5.0, 6.0)], "x double, y double"), ["x", "y"])
    assert list(scaler.transform(other, "features", "z").first()["z"]) == [3.0, 1.0]


def test_components_of_two_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = -0.8 * x + rng.normal(size=500) * 0.3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    scaled = scaling.standardize(scaling.assemble(df, ["x", "y"]))
    fitted = scaling.fit_components(scaled, 2)
    r = abs(np.corrcoef(x, y)[0, 1])
    assert fitted.explained == pytest.approx([(1 + r) / 2, (1 - r) / 2])
    assert scaling.choose_k(scaled, 0.9) == 1 and scaling.choose_k(scaled, 0.99) == 2
    found = vector_elements(fitted.transform(scaled), "pcaFeatures", ["p1", "p2"]).collect()
    z = [(np.array(v) - np.mean(v)) / np.std(v, ddof=1) for v in (x, y)]
    expected = {round(a, 9): ((a_z - b_z) / math.sqrt(2), (a_z + b_z) / math.sqrt(2)) for a, a_z, b_z in zip(x, *z)}
    assert all((row.p1, row.p2) == pytest.approx(expected[round(row.x, 9)]) for row in found)


def test_projection(spark):
    data = [(i, "c", str(i % 7), i % 2 == 0, 41.0 + i / 100) for i in range(50)]
    df = spark.createDataFrame(data, "ID int, Block string, Ward string, Arrest boolean, Latitude double")
    found = project(df)
    assert found.points.columns == ["ID", "pca1", "pca2"] and found.points.count() == 50
    assert 0 < sum(found.components.explained) <= 1 + 1e-9


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(8000)
    train, test = splits.train_test_split(df, ["id"], 25)
    again = splits.train_test_split(df.repartition(7), ["id"], 25)[1]
    ids = {r.id for r in test.collect()}
    assert ids == {r.id for r in again.collect()} and 1800 < len(ids) < 2200
    assert train.count() + len(ids) == 8000
    assert ids != {r.id for r in splits.train_test_split(df, ["id"], 25, seed=7)[1].collect()}
    folds = splits.with_folds(df, ["id"]).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4] and min(r["count"] for r in folds) > 1400


def test_moments_of_one_pass(spark):
    """Against the scaler and the components that each read all rows; merged parts equal the whole."""
    rnd = random.Random(4)
    rows = [(rnd.gauss(1e6, 2), rnd.gauss(0, 1), 7.0, rnd.random()) for _ in range(400)]
    rows = [(a, a * 0.3 + b, c, d) for a, b, c, d in rows]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, 3.0)], "`a.x` double, b double, c double, d double")
    names = ["a.x", "b", "c", "d"]
    found = Moments.fit(df, names)
    assert found.n == 400
    scaled = scaling.standardize(scaling.assemble(df.toDF("a", "b", "c", "d").dropna(), ["a", "b", "c", "d"]))
    fitted = scaling.fit_components(scaled, 3)
    expected = vector_elements(fitted.transform(scaled), "pcaFeatures", ["p", "q", "r"]).orderBy("d").collect()
    turned = found.components().first(3)
    points = vector_elements(turned.transform(df.filter("`a.x` is not null")), "pcaFeatures", ["p", "q", "r"]).orderBy("d").collect()
    for x, y in zip(expected, points):
        assert [x.p, x.q, x.r] == pytest.approx([y.p, y.q, y.r], abs=1e-6)
    assert list(turned.explained) == pytest.approx(fitted.explained, abs=1e-9)
    assert found.components().enough(0.9) == scaling.choose_k(scaled, 0.9)
    parts = [Moments.fit(df.filter(f"d {side} 0.3"), names) for side in ("<", ">=")]
    merged = parts[0].merged(parts[1])
    assert merged.n == found.n and merged.means == pytest.approx(found.means)
    assert merged.covariances == pytest.approx(found.covariances, rel=1e-6, abs=1e-9)
    assert {r.feature: r.std for r in merged.described(spark).collect()}["c"] == pytest.approx(0.0, abs=1e-9)
    assert {(r.a, r.b): r.r for r in found.correlated(spark).collect()}["c", "d"] is None
    with pytest.raises(ValueError):
        Moments.fit(df.filter("false"), names)


def test_heavy_unseen_value(spark):
    """A value that no index knows fills half of the rows: found, answered, and spread over the tasks."""
    known = spark.createDataFrame([(f"v{k % 90}",) for k in range(400)], "v string")
    model = FrequencyIndexer(["v"], ["i_v"], "keep", head_entries=5).fit(known)
    i = F.col("id")
    rows = spark.range(4000).select(i.alias("key"), F.when(i % 2 == 0, "new").when(i % 3 == 0, "v89").otherwise(F.concat(F.lit("v"), (i % 95).cast("string"))).alias("v"))
    order = expected_ranks([r.v for r in known.collect()])
    found = model.transform(rows).collect()
    assert len(found) == 4000 and all(r.i_v == order.get(r.v, 90) for r in found)
    heavy = skew.heavy_values(rows, {3: F.col("v")})
    assert {(3, "new"), (3, "v89")} <= set(heavy)
    sought = rows.select(F.col("key").alias("__row"), F.lit(0).alias("no"), indexing.digest(F.col("v")).alias("key"))
    tail = model.index_of("v").select(F.lit(0).alias("no"), indexing.digest(F.col("value")).alias("key"), "rank")
    told = model._with_heavy(sought, [(0, v) for _, v in heavy], tail)
    tasks = sorted(r["count"] for r in told.groupBy(F.expr("pmod(hash(no, spread_key), 16)")).count().collect())
    assert len(tasks) == 16 and tasks[-1] < 2 * tasks[8]
    assert {r.heavy_rank for r in told.filter(F.col("key") == indexing.digest(F.lit("v89"))).collect()} == {order["v89"]}


def test_heavy_texts_beyond_the_broadcast(spark):
    """Half of the rows hold one text and a third none; the plan still shuffles, evenly, and the result stays."""
    i = F.col("id")
    texts = F.when(i % 2 == 0, "one hot text").when(i % 3 == 0, None).otherwise(F.concat(F.lit("word"), i.cast("string"), F.lit(" hot")))
    df = spark.range(3000).select("id", texts.alias("a"), F.when(i % 5 > 0, "hot again").alias("b"))
    fitted = vocabulary.fit_vocabulary(df, ["a", "b"])
    names = {"a": "seq_a", "b": "seq_b"}
    expected = vocabulary.encode_columns(df, names, fitted)
    found = vocabulary.encode_columns(df, names, fitted, broadcast_bytes=2000)
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    spread = skew.spread(indexing.digest(F.col("a")), F.col("a") == "one hot text", F.col("id"))
    tasks = sorted(r["count"] for r in df.groupBy(F.pmod(F.hash(spread), F.lit(16))).count().collect())
    assert len(tasks) == 16 and tasks[-1] < 2 * tasks[8]


def test_decode_many_labels(spark):
    labels = [f"class {i}" for i in range(2500)]
    df = spark.range(3000).select("id", (F.col("id") % 2600).cast("double").alias("p"))
    found = decode(df, "p", labels, "named")
    assert found.columns == ["id", "p", "named"]
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert all(r.named == (labels[int(r.p)] if r.p < 2500 else None) for r in found.collect())
    few = decode(df, "p", labels[:3], "named").filter("id < 4").orderBy("id").collect()
    assert [r.named for r in few] == ["class 0", "class 1", "class 2", None]


def test_heads_are_looked_up_in_one_call(spark):
    """No join for each column: with many of them the stage's code would be too large to be compiled."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(200).select("id", *[F.when(F.col("id") % 7 != 0, (F.col("id") % (i + 2)).cast("string")).alias(c) for i, c in enumerate(names)])
    indexed = FrequencyIndexer(names, handleInvalid="keep").fit(df).transform(df)
    assert "Join" not in indexed._jdf.queryExecution().optimizedPlan().toString()
    small = FrequencyIndexer(names, handleInvalid="keep", head_entries=24).fit(df).transform(df)
    assert sorted(map(tuple, indexed.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
    assert {r.c0_index for r in indexed.filter("id % 7 = 0").select(F.col(indexed.columns[13]).alias("c0_index")).collect()} == {2.0}


def test_moments_far_from_zero(spark):
    """Merged from the tasks' own; a constant column has no variance."""
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 11 + 1e9).alias("a"), (F.col("id") * 0.5).alias("b"), F.lit(3.0).alias("c"))
    found = Moments.fit(df, ["a", "b", "c"])
    a, b = np.arange(5000) % 11 + 1e9, np.arange(5000) * 0.5
    assert found.n == 5000 and np.allclose(found.covariances[:2, :2], np.cov([a, b], bias=True), rtol=1e-9, atol=1e-4)
    assert not found.covariances[2].any() and list(found.least) == [1e9, 0.0, 3.0]


def test_a_large_head_is_hashed_once_a_task(monkeypatch):
    """Before, every batch hashed all values of the head anew."""
    import pyarrow as pa

    from blotter.operators import indexing

    hashed = []
    plain = indexing.pc.index_in
    monkeypatch.setattr(indexing.pc, "index_in", lambda texts, value_set, **kw: hashed.append(len(value_set)) or plain(texts, value_set=value_set, **kw))

    class Sent:
        value = [pa.array([b"%d" % i for i in range(1000)]), pa.array([b"x", b"y"])]

    look_up = indexing._in_values(Sent)
    for first in range(0, 1200, 100):
        texts = [b"%d" % i for i in range(first, first + 99)] + [None]
        got = look_up(pa.array(texts), pa.array([b"y", None, b"z"] * 33 + [b"x"])).to_pylist()
        assert [r["h0"] for r in got] == [i if i < 1000 else None for i in range(first, first + 99)] + [None]
        assert [r["h1"] for r in got] == [1, None, None] * 33 + [0]
    assert set(hashed) == {2}
