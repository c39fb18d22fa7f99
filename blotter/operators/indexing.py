"""Frequency indexes for columns with any number of values.

``StringIndexer`` keeps all values of a column on the driver and in every task,
which does not work for columns such as occurrence times that have about as many
values as the table has rows. Here the index is a table: it is counted in one
pass for all columns and looked up by joins.

Lookups and skew. Rank 0 is the most frequent value, so the head of the index is
exactly the set of values that could overload a join. Heads are broadcast; one budget of
entries serves all columns of a model together, and a batch of rows is looked up in all of them at once.
What the heads leave open are rare values. They are looked up as narrow triples
(row, column, digest), all columns in one shuffle, and brought back to their rows
in another; rows without open values take no part in either. A value may be rare or unknown in the
index and yet fill the rows at hand: a sketch of those finds such values, which are looked up
once and sent by broadcast too, so that no task of the shuffle gets more of them than others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.names import column, index_name, literal, quoted
from blotter.operators.ranking import frequency_ranks
from blotter.operators.skew import heavy_values, spread
from blotter.staging import stage

# Entries that the heads of all columns of a model have together; some 50 MB as hash tables.
HEAD_ENTRIES = 500_000
# Labels that a plan holds as literals.
LITERAL_LABELS = 1_000
_ROW, _OPEN, _FOUND, _HEADS = "__row", "__open", "__found", "__heads"


@dataclass(frozen=True)
class IndexSize:
    """How many values an index has and how many of the most frequent ones are broadcast."""

    values: int
    head: int


def plan_heads(values: dict[str, int], entries: int) -> dict[str, IndexSize]:
    """Share a budget of entries between columns; what small columns leave, larger ones get."""
    sizes, left = {}, entries
    for at, name in enumerate(sorted(values, key=lambda n: (values[n], n))):
        head = min(values[name], left // (len(values) - at))
        sizes[name], left = IndexSize(values[name], head), left - head
    return sizes


def digest(text: Column) -> Column:
    """What values are looked up by."""
    return F.unhex(F.md5(text))


def _in_values(sent) -> Callable[..., pa.Array]:
    """A function that finds, batch after batch, the texts of each column among the values sent for it.

    ``index_in`` hashes the values anew in every call; those that outnumber a batch are hashed once a task.
    """
    hashed: dict[int, dict[bytes, int]] = {}

    def places(no: int, texts: pa.Array, values: pa.Array) -> pa.Array:
        if len(values) <= len(texts):
            return pc.index_in(texts.cast(values.type), value_set=values, skip_nulls=True).cast("int64")
        if no not in hashed:
            hashed[no] = {value: place for place, value in enumerate(values.to_pylist())}
        return pa.array(map(hashed[no].get, texts.to_pylist()), pa.int64())

    def look_up(*columns: pa.Array) -> pa.Array:
        found = [places(i, texts, values) for i, (texts, values) in enumerate(zip(columns, sent.value))]
        return pa.StructArray.from_arrays(found, [f"h{i}" for i in range(len(found))])

    return look_up


class FrequencyIndexer(Estimator, HasInputCols, HasOutputCols, HasHandleInvalid):
    """Replace each value by its frequency rank in its column, as a double.

    Equal counts are ranked by value. Values not met when fitting, and nulls, are an
    error, or with ``handleInvalid="keep"`` get the number of known values, or with
    ``"skip"`` cost the row. ``head_entries`` bounds what is broadcast, over all columns; it
    changes the plan, not the result.
    """

    def __init__(
        self,
        inputCols: list[str],
        outputCols: list[str] | None = None,
        handleInvalid: str = "error",
        head_entries: int | None = None,
    ):
        super().__init__()
        if handleInvalid not in ("error", "keep", "skip"):
            raise ValueError(f"handleInvalid must be error, keep or skip, not {handleInvalid!r}")
        self.head_entries = HEAD_ENTRIES if head_entries is None else head_entries
        outputCols = outputCols or [index_name(c) for c in inputCols]
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), handleInvalid=handleInvalid)

    def _fit(self, dataset: DataFrame) -> FrequencyIndexModel:
        # By column, since every lookup reads the values of one column.
        ranks = stage(frequency_ranks(dataset, self.getInputCols()), "index", by="column")
        counted = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count("*").alias("n")).collect()}
        values = {c: counted.get(c, 0) for c in self.getInputCols()}
        return self._copyValues(FrequencyIndexModel(ranks, plan_heads(values, self.head_entries)))


class FrequencyIndexModel(Model, HasInputCols, HasOutputCols, HasHandleInvalid):
    """A fitted :class:`FrequencyIndexer`; ``ranks`` is the staged index ``(column, value, n, rank)``."""

    def __init__(self, ranks: DataFrame, sizes: dict[str, IndexSize]):
        super().__init__()
        self.ranks = ranks
        self.sizes = sizes

    def index_of(self, name: str) -> DataFrame:
        return self.ranks.where(f"column = {literal(name)}")

    def labels(self, name: str) -> list[str]:
        """The values of one column by rank, for decoding: classes, which a classifier has to name as well."""
        return [r["value"] for r in self.index_of(name).orderBy("rank").collect()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        invalid = self.getHandleInvalid()
        names = list(zip(self.getInputCols(), self.getOutputCols()))
        sizes = [self.sizes.get(name, IndexSize(0, 0)) for name, _ in names]
        texts = [column(name).cast("string") for name, _ in names]
        large = [i for i, size in enumerate(sizes) if size.values > size.head]
        rows = dataset.withColumn(_ROW, F.monotonically_increasing_id()) if large else dataset
        rows = rows.withColumn(_HEADS, self._in_heads(texts, [size.head for size in sizes]))
        ranks = [F.col(_HEADS)[f"h{i}"] for i in range(len(names))]
        if large:
            # Open values leave their rows and come back, so rows need numbers that stay; the heads are looked up once.
            rows = stage(rows, "rows")
            rows = self._with_rare(rows, [(i, names[i][0], texts[i], sizes[i]) for i in large])
            ranks = [F.coalesce(r, F.element_at(_FOUND, F.lit(i))) if i in large else r for i, r in enumerate(ranks)]
        outputs = []
        for (name, out), size, text, rank in zip(names, sizes, texts, ranks):
            rank = rank.cast("double")
            if invalid == "keep":
                rank = F.coalesce(rank, F.lit(float(size.values)))
            elif invalid == "error":
                message = F.concat(F.lit(f"no index in {name} for "), F.coalesce(text, F.lit("null")))
                rank = F.coalesce(rank, F.raise_error(message).cast("double"))
            outputs.append(rank.alias(out))
        indexed = rows.select(*[column(c) for c in dataset.columns], *outputs)
        if invalid == "skip":
            indexed = indexed.na.drop(subset=[quoted(c) for c in self.getOutputCols()])
        return indexed

    def _in_heads(self, texts: list[Column], heads: list[int]) -> Column:
        """A struct of the ranks of the texts in the heads of their columns, null where a text is not there.

        All columns are looked up in one call for a batch of rows. A join for each makes, of many columns,
        a stage of code that is too large to be compiled.
        """
        in_head = F.lit(False)
        for name, head in dict(zip(self.getInputCols(), heads)).items():
            in_head = in_head | ((F.col("column") == F.lit(name)) & (F.col("rank") < head))
        found = self.ranks.where(in_head).select("column", F.col("value").cast("binary").alias("value"), "rank").toArrow()
        found = found.sort_by("rank")
        own = {c: found.filter(pc.equal(found["column"], c))["value"].combine_chunks() for c in set(self.getInputCols())}
        sent = self.ranks.sparkSession.sparkContext.broadcast([own[c] for c in self.getInputCols()])

        look_up = F.arrow_udf(_in_values(sent), ", ".join(f"h{i} long" for i in range(len(texts))))
        return look_up(*[t.cast("binary") for t in texts])

    def _with_rare(self, rows: DataFrame, large: list[tuple]) -> DataFrame:
        """The rows with a map from column number to rank for the values that the heads left open."""
        triples = [
            F.when(F.col(_HEADS)[f"h{i}"].isNull() & text.isNotNull(), F.struct(F.lit(i).alias("no"), digest(text).alias("key")))
            for i, _, text, _ in large
        ]
        opened = rows.withColumn(_OPEN, F.array_compact(F.array(*triples)))
        open_ = opened.filter(F.size(_OPEN) > 0)
        tails = [
            self.index_of(name).where(F.col("rank") >= size.head).select(F.lit(i).alias("no"), digest(F.col("value")).alias("key"), "rank")
            for i, name, _, size in large
        ]
        tail = reduce(DataFrame.unionByName, tails)
        sought = open_.select(_ROW, F.inline(_OPEN))
        heavy = heavy_values(rows, {i: F.when(F.col(_HEADS)[f"h{i}"].isNull(), text) for i, _, text, _ in large})
        sought = self._with_heavy(sought, heavy, tail)
        known = tail.select(F.col("no").alias("__no"), F.col("key").alias("__key"), F.col("rank").alias("__rank"))
        looked_up = sought.join(known, (F.col("no") == F.col("__no")) & (F.col("spread_key") == F.col("__key")), "left")
        rank = F.coalesce("heavy_rank", "__rank").cast("long")
        met = looked_up.filter(rank.isNotNull()).groupBy(_ROW).agg(F.map_from_entries(F.collect_list(F.struct("no", rank))).alias(_FOUND))
        answered = opened.filter(F.size(_OPEN) == 0).withColumn(_FOUND, F.lit(None).cast("map<int,bigint>"))
        return open_.join(met, _ROW, "left").unionByName(answered).drop(_OPEN)

    @staticmethod
    def _with_heavy(sought: DataFrame, heavy: list[tuple[int, str]], tail: DataFrame) -> DataFrame:
        """The sought values with the rank of heavy ones, and a key under which the others are looked up."""
        spark = sought.sparkSession
        asked = spark.createDataFrame(heavy, "no int, value string").select("no", digest(F.col("value")).alias("key"))
        found = {(r["no"], bytes(r["key"])): r["rank"] for r in tail.join(F.broadcast(asked), ["no", "key"]).collect()} if heavy else {}
        answers = [(no, key, found.get((no, key))) for no, key in ((r["no"], bytes(r["key"])) for r in asked.collect())]
        told = spark.createDataFrame(answers, "no int, key binary, heavy_rank long").withColumn("settled", F.lit(True))
        joined = sought.join(F.broadcast(told), ["no", "key"], "left")
        return joined.withColumn("spread_key", spread(F.col("key"), F.col("settled").isNotNull(), F.col(_ROW)))


def decode(df: DataFrame, prediction: str, labels: list[str], out: str) -> DataFrame:
    """Turn predicted ranks back into the values they stand for, null where there is none.

    Few labels are an array in the plan; more are a table that is joined.
    """
    rank = column(prediction).cast("int")
    if len(labels) <= LITERAL_LABELS:
        return df.withColumn(out, F.get(F.array(*[F.lit(v) for v in labels]), rank))
    named = df.sparkSession.createDataFrame(list(enumerate(labels)), "__no int, __label string")
    kept = [column(c) for c in df.columns if c != out]
    return df.join(named, rank == F.col("__no"), "left").select(*kept, F.col("__label").alias(out))
