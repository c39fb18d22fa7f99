"""One vocabulary over several text columns, and texts as sequences of word numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions.names import column
from blotter.functions.text import tokenize
from blotter.operators.counts import token_counts, value_counts
from blotter.operators.indexing import HEAD_ENTRIES, IndexSize, _in_values, digest, plan_heads
from blotter.operators.positions import with_position
from blotter.operators.skew import HEAVY_SHARE, spread
from blotter.staging import stage

# A table of distinct texts is broadcast up to this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Vocabulary:
    """Word numbers from 1, the most frequent word first: ``words (token, n, id)``."""

    words: DataFrame
    size: IndexSize


def fit_vocabulary(df: DataFrame, names: list[str], min_count: int = 1, head_entries: int = HEAD_ENTRIES) -> Vocabulary:
    """Number the words of all named columns together; equally frequent words by alphabet.

    Words met fewer than ``min_count`` times are outside the vocabulary. Texts that repeat are
    cut into words once. The ``head_entries`` most frequent words are broadcast when texts are
    numbered, which changes the plan and not the result.
    """
    texts = value_counts(df, names).groupBy("value").agg(F.sum("n").alias("n"))
    counts = token_counts(texts, ["value"], weight="n").filter(F.col("n") >= min_count)
    placed = with_position(counts, [F.desc("n"), F.col("token")], "rank", "vocabulary")
    size = plan_heads({"": placed.count()}, head_entries)[""]
    return Vocabulary(placed.select("token", "n", (F.col("rank") + 1).cast("int").alias("id")), size)


def _word_numbers(look_up: Callable[..., pa.Array], others: bool) -> Callable[[pa.Array], pa.Array]:
    """A function that numbers the words of a batch of texts, from 1.

    Words that are not looked up there are left out, or with ``others`` are listed, each once for a
    text, as ``open``; their numbers are then their places in that list, as -1, -2, ….
    """

    def number(texts: pa.Array) -> pa.Array:
        words = texts.flatten().cast(pa.binary())
        found = look_up(words).field(0)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        ids = found.fill_null(-1).to_numpy(zero_copy_only=False) + 1
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        unknown = np.flatnonzero(~known) if others else np.zeros(0, dtype=np.int64)
        coded = words.take(pa.array(unknown)).dictionary_encode()
        size = max(1, len(coded.dictionary))
        pairs, place = np.unique(of[unknown] * size + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        start = np.searchsorted(pairs // size, np.arange(len(texts) + 1))
        ids[unknown] = start[of[unknown]] - place - 1
        kept = ids != 0
        upto = np.searchsorted(of[kept], np.arange(len(texts) + 1))
        numbers = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids[kept], pa.int32()))
        listed = coded.dictionary.take(pa.array(pairs % size)).cast(pa.string())
        return pa.StructArray.from_arrays([numbers, pa.ListArray.from_arrays(pa.array(start, pa.int32()), listed)], ["ids", "open"])

    return number


def _filled() -> Callable[..., pa.Array]:
    """A function that puts the ranks found for a text's open words in their places; words without one are left out."""

    def fill(ids: pa.Array, opened: pa.Array, places: pa.Array, ranks: pa.Array) -> pa.Array:
        def rows(lists: pa.Array) -> np.ndarray:
            return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

        start = np.append(0, np.cumsum(opened.to_numpy(zero_copy_only=False)))
        told = np.zeros(start[-1], dtype=np.int64)
        told[start[rows(places)] + places.flatten().to_numpy(zero_copy_only=False)] = ranks.flatten().to_numpy(zero_copy_only=False) + 1
        of, number = rows(ids), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(number < 0)
        number[unknown] = told[start[of[unknown]] - number[unknown] - 1]
        kept = number > 0
        upto = np.searchsorted(of[kept], np.arange(len(ids) + 1))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(number[kept], pa.int32()))

    return fill


def texts_to_sequences(
    df: DataFrame, key: str, names: dict[str, str], vocabulary: Vocabulary
) -> DataFrame:
    """Per row, the word numbers of each text in order: ``(key, *outputs)``.

    ``names`` maps text columns to output columns; ``key`` must be unique, and rows without one
    are left out. Words outside the vocabulary are left out; a text without words gives an empty sequence.
    Texts stay whole: the words of a batch of them are looked up at once in the broadcast head of the
    vocabulary. What the head leaves open is looked up by shuffle, each word once for a text, and comes back to its row.
    """
    index, size = vocabulary.words, vocabulary.size
    others = size.values > size.head
    head = index.where(F.col("id") <= size.head).select(F.col("token").cast("binary").alias("value"), "id").toArrow().sort_by("id")
    sent = df.sparkSession.sparkContext.broadcast([head["value"].combine_chunks()])
    number = F.arrow_udf(_word_numbers(_in_values(sent), others), "ids array<int>, open array<string>")
    words = [F.coalesce(tokenize(column(n)), F.array().cast("array<string>")) for n in names]
    numbered = df.filter(column(key).isNotNull()).select(
        column(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), *[number(w).alias(f"__{i}") for i, w in enumerate(words)]
    )
    if not others:
        return numbered.select(F.col("__key").alias(key), *[F.col(f"__{i}.ids").alias(out) for i, out in enumerate(names.values())])

    # Read for its open words and for its rows, which need numbers that stay.
    numbered = stage(numbered, "numbered")

    def opened(no: int) -> Column:
        return F.transform(
            F.col(f"__{no}.open"),
            lambda word, at: F.struct(F.lit(no).alias("no"), at.alias("place"), digest(word).alias("key")),
        )

    sought = numbered.select("__row", F.inline(F.concat(*[opened(i) for i in range(len(names))])))
    tail = index.where(F.col("id") > size.head).select(digest(F.col("token")).alias("key"), (F.col("id") - 1).alias("rank"))
    met = sought.join(tail, "key").groupBy("__row").agg(F.collect_list(F.struct("no", "place", "rank")).alias("__found"))
    rows = numbered.join(met, "__row", "left")
    fill = F.arrow_udf(_filled(), "array<int>")

    def sequence(no: int) -> Column:
        own = F.filter(F.coalesce("__found", F.array().cast("array<struct<no:int,place:int,rank:int>>")), lambda f: f["no"] == no)
        return fill(F.col(f"__{no}.ids"), F.size(f"__{no}.open"), F.transform(own, lambda f: f["place"]), F.transform(own, lambda f: f["rank"]))

    return rows.select(F.col("__key").alias(key), *[sequence(i).alias(out) for i, out in enumerate(names.values())])


def encode_columns(
    df: DataFrame, names: dict[str, str], vocabulary: Vocabulary, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a sequence column for each named text column; null texts give empty ones.

    Every distinct text is encoded once and joined to the rows by the text itself, so rows need
    no key. The table of texts and sequences is broadcast if it measures at most
    ``broadcast_bytes``, which is one budget for all columns; beyond that the texts that stand in
    many rows are, as far as they measure no more, and the rows are shuffled by the others. The
    result is the same.
    """
    counted = value_counts(df, list(names)).groupBy("value").agg(F.max("n").alias("n"))
    texts = stage(counted, "texts")
    encoded = stage(texts_to_sequences(texts, "value", {"value": "__ids"}, vocabulary), "sequences")
    width = F.octet_length("value") + 4 * F.size("__ids") + 64
    size = (encoded.agg(F.sum(width)).first()[0] or 0) * len(names)
    if size > broadcast_bytes:
        return _encode_by_shuffle(df, names, encoded, texts, broadcast_bytes // len(names))
    for i, (name, out) in enumerate(names.items()):
        own = encoded.select(F.col("value").alias(f"__text_{i}"), F.col("__ids").alias(f"__ids_{i}"))
        df = df.join(F.broadcast(own), column(name).cast("string") == F.col(f"__text_{i}"), "left")
        df = df.withColumn(out, F.coalesce(f"__ids_{i}", F.array().cast("array<int>"))).drop(f"__text_{i}", f"__ids_{i}")
    return df


def _encode_by_shuffle(df: DataFrame, names: dict[str, str], encoded: DataFrame, texts: DataFrame, budget: int) -> DataFrame:
    """Frequent texts by broadcast, so that no task of the shuffle gets all rows of one of them."""
    rows = texts.agg(F.sum("n")).first()[0] or 0
    often = texts.filter(F.col("n") * HEAVY_SHARE > rows).select("value", "n")
    heavy = stage(encoded.join(F.broadcast(often), "value").select(F.unhex(F.md5("value")).alias("key"), "__ids", "n"), "texts-heavy")
    # Fewer than HEAVY_SHARE texts for each column; of long sequences those that occur most.
    upto = F.sum(4 * F.size("__ids") + 64).over(Window.orderBy(F.desc("n"), "key").rowsBetween(Window.unboundedPreceding, 0))
    heavy = heavy.select("key", "__ids", upto.alias("upto")).filter(F.col("upto") <= budget).drop("upto")
    digests = encoded.select(F.unhex(F.md5("value")).alias("key"), "__ids")
    # Numbered before anything is shuffled, so that a repeated task deals out rows as before.
    df = df.withColumn("__row", F.monotonically_increasing_id())
    for i, (name, out) in enumerate(names.items()):
        key, near, far, by = (f"__{what}_{i}" for what in ("key", "near", "far", "by"))
        df = df.withColumn(key, F.unhex(F.md5(column(name).cast("string"))))
        df = df.join(F.broadcast(heavy.toDF(f"{key}_h", near)), F.col(key) == F.col(f"{key}_h"), "left")
        df = df.withColumn(by, spread(F.col(key), F.col(near).isNotNull(), F.col("__row")))
        df = df.join(digests.toDF(f"{key}_t", far).hint("merge"), F.col(by) == F.col(f"{key}_t"), "left")
        ids = F.coalesce(near, far, F.array().cast("array<int>"))
        df = df.withColumn(out, ids).drop(key, near, far, by, f"{key}_h", f"{key}_t")
    return df.drop("__row")
