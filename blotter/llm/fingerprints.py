"""Document fingerprints by consistent weighted sampling, and rows paired with the next one.

A document is a bag of terms (runs of five words) weighted by how often they occur. Sample j draws
for each term, from its number alone, r and c from Gamma(2, 1) and b from [0, 1); with
t = floor(ln w / r + b) the term of least ln c - r (t - b + 1) wins, and (term, t) is the sample.
Two documents agree in a sample with the probability of their generalised Jaccard similarity,
sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.tables import named, partitions
from blotter.llm.tokens import SPACES, mixed, numbers, pieces, shingles

SAMPLES = 64
TERM_WORDS = 5
_LEVELS = 1 << 16
_TERMS_AT_ONCE = 1024
_ROWS_AT_ONCE = 512
_LEAST = -(1 << 63)


def _gamma_levels() -> np.ndarray:
    """Middle of each of ``_LEVELS`` equally likely parts of Gamma(2, 1), whose CDF is 1 - (1 + x) exp(-x)."""
    upper = 1 - (np.arange(_LEVELS) + 0.5) / _LEVELS
    x = np.where(upper > 0.5, np.sqrt(2 * (1 - upper)), -np.log(upper) + 1.0)
    for _ in range(60):
        x = np.maximum(x + ((1 + x) * np.exp(-x) - upper) / (x * np.exp(-x)), 1e-6)
    return x


class Sampler:
    """The fixed random numbers behind the samples; made once in each task."""

    def __init__(self, samples: int = SAMPLES):
        levels = _gamma_levels()
        self.r, self.log_c = levels.astype(np.float32), np.log(levels).astype(np.float32)
        self.factors = (numbers(samples, 21) | np.uint64(1))[:, None]
        self.marks = numbers(samples, 22)
        self.logs = np.log(np.arange(1, 4097)).astype(np.float32)

    def _log_weight(self, counts: np.ndarray) -> np.ndarray:
        if counts.max() <= len(self.logs):
            return self.logs[counts - 1]
        return np.array([math.log(c) for c in counts.tolist()], dtype=np.float32)

    def sample(self, terms: np.ndarray) -> np.ndarray:
        """16 bits for each sample of one document's terms; none if there are none."""
        if not len(terms):
            return np.zeros(0, np.uint16)
        terms, counts = np.unique(terms, return_counts=True)
        weights = self._log_weight(counts)
        rows = np.arange(len(self.marks))
        best, won, level = np.full(len(rows), np.inf, np.float32), np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
        for low in range(0, len(terms), _TERMS_AT_ONCE):
            part, weight = terms[low : low + _TERMS_AT_ONCE], weights[low : low + _TERMS_AT_ONCE]
            drawn = part[None, :] * self.factors
            r = self.r[(drawn >> np.uint64(48)).astype(np.intp)]
            score = self.log_c[((drawn >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
            b = ((drawn >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / _LEVELS)
            t = np.floor(weight[None, :] / r + b) if weight.any() else np.zeros_like(b)
            score -= r * (t - b + np.float32(1))
            at = score.argmin(axis=1)
            better = score[rows, at] < best
            best[better] = score[rows, at][better]
            won[better] = part[at[better]]
            level[better] = t[rows, at][better].astype(np.int64)
        return (mixed(won ^ self.marks ^ (level.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(48)).astype(np.uint16)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        return [self.sample(row) for piece in pieces(pa.array(texts, pa.string()), SPACES) for row in shingles(piece, TERM_WORDS)]


def as_text(sample: np.ndarray) -> str:
    """Four hexadecimal digits for each sample."""
    return sample.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; two documents without words are alike, one without is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        prints = [as_text(s) for low in range(0, len(texts), _ROWS_AT_ONCE) for s in sampler.of(texts[low : low + _ROWS_AT_ONCE])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and ``fingerprint`` of every row: without a shuffle, equal for equal texts, empty for texts without words."""
    kind = docs.select(named(docs, id_column)).schema[0].dataType.simpleString()
    narrow = docs.select(named(docs, id_column).alias("doc_id"), named(docs, text_column).alias("text"))
    return narrow.mapInArrow(_fingerprint, f"doc_id {kind}, fingerprint string").withColumnRenamed("doc_id", id_column)


def _place(key: Column, splits: list[int], low: int = 0) -> Column:
    """How many of the sorted ``splits`` are at most ``key``, by halving."""
    if not splits:
        return F.lit(low)
    middle = len(splits) // 2
    return F.when(key < splits[middle], _place(key, splits[:middle], low)).otherwise(_place(key, splits[middle + 1 :], low + middle + 1))


def in_order(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(block, ahead, doc_id, text): rows in blocks of consecutive ids, each sorted and followed by the next block's first.

    The row after the last of all is the first of all. Ids are whole numbers, null first; rows of
    one id are in the order of their texts' hashes. Texts are exchanged once.
    """
    spark = docs.sparkSession
    rows = docs.select(named(docs, id_column).cast("long").alias("doc_id"), named(docs, text_column).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    blocks = 8 * partitions(spark)
    found = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] or []
    splits = sorted(set(found))
    block = _place(F.col("key"), splits)
    # One number for each block reaches the driver.
    firsts = rows.select(block.alias("block"), "key").groupBy("block").agg(F.min("key").alias("key")).orderBy("block").collect()
    before = [0] * (len(splits) + 1)
    for i, r in enumerate(firsts):
        before[r.block] = firsts[i - 1].block
    own = F.struct(F.col("block"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.element_at(F.array(*[F.lit(b) for b in before]), F.col("block") + 1).alias("block"), F.lit(True).alias("ahead"))
    first = F.col("key").isin([r.key for r in firsts])
    placed = rows.withColumn("block", block).withColumn("at", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))))
    placed = placed.select("at.block", "at.ahead", "key", F.xxhash64("text").alias("tie"), "doc_id", "text")
    return placed.repartition(partitions(spark), "block").sortWithinPartitions("block", "ahead", "key", "tie").select("block", "ahead", "doc_id", "text")


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    waiting = None  # the last row so far: block, id, text, sample
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for whole in batches:
        for low in range(0, whole.num_rows, _ROWS_AT_ONCE):
            batch = whole.slice(low, _ROWS_AT_ONCE)
            blocks, ahead, ids = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3).fill_null("").to_pylist()
            pairs = []
            for block, is_ahead, id_, text, sample in zip(blocks, ahead, ids, texts, sampler.of(texts)):
                if waiting is not None and waiting[0] == block:
                    pairs.append((*waiting[1:], text, sample))
                    waiting = None
                if not is_ahead:
                    waiting = (block, id_, text, sample)
            changed = [edited(text, following) for _, text, _, following, _ in pairs]
            rows = [
                (id_, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, following))
                for (id_, text, own, _, following), new, other in zip(pairs, changed, sampler.of(changed))
            ]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint next to those of its edited text and of the next document.

    A null text is empty; a text without words has the empty fingerprint, is alike (1) another
    such and unlike (0) any other. A single row is its own next. Repeated ids follow one another
    in the order of their texts' hashes. Other columns are neither read nor returned.
    """
    return in_order(docs, id_column, text_column).mapInArrow(_compare, _PAIRS)
