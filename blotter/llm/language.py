"""Language identification with a string kernel.

A document's features are the byte n-grams of one to four letters that occur in it (presence, not
counts), over its letters lower-cased with everything else as one blank; the blended-spectrum kernel
of two documents is the cosine of their presence vectors. Landmark documents give the Nystrom
approximation, on which a ridge regression is fitted for each language against the rest. As the
kernel is a product of presence vectors, a document's scores are presence @ (landmarks.T @ weights)
over its length: batches of documents are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.tables import named
from blotter.llm.tokens import mixed, text_bytes

GRAMS = (1, 2, 3, 4)
FEATURE_BITS = 15
UNKNOWN = "und"
SAMPLE_ROWS = 2000
LANDMARKS = 400
RIDGE = 1e-2
SHARPNESS = 6.0
_BATCH = 64
_PART = 1 << 20

_SEEN = np.zeros(256, dtype=np.uint8)  # byte -> lower-cased letter, or blank
_SEEN[:] = 0x20
_SEEN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[0x80:] = np.arange(0x80, 0x100)


def _presence(data: np.ndarray, row: np.ndarray) -> None:
    """Mark the features of one text, a megabyte of it at a time, in a row of zeros."""
    for low in range(0, len(data), _PART):
        seen = _SEEN[data[max(0, low - max(GRAMS)) : low + _PART]]
        blank = seen == 0x20
        seen = seen[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)
        code = np.zeros(len(seen), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(seen) < n:
                break
            code = code[: len(seen) - n + 1] * np.uint64(256) + seen[n - 1 :]
            if n in GRAMS:
                row[(mixed(code + np.uint64(n << 40)) >> np.uint64(64 - FEATURE_BITS)).astype(np.intp)] = 1


def _batches(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, data = text_bytes(column)
    for low in range(0, len(column), _BATCH):
        rows = range(low, min(len(column), low + _BATCH))
        grid = np.zeros((len(rows), 1 << FEATURE_BITS), dtype=np.float32)
        for i, r in enumerate(rows):
            _presence(data[offsets[r] : offsets[r + 1]], grid[i])
        yield grid


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(row.astype(bool)).tobytes() for grid in _batches(batch.column(1)) for row in grid]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])


@dataclass
class LanguageModel:
    """``weights``: one column of feature weights for each of ``languages``."""

    languages: list[str]
    weights: np.ndarray


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(rows: DataFrame, id_column: str, text_column: str, lang_column: str, sample_rows: int) -> DataFrame:
    """(lang, text) of about ``sample_rows`` labelled rows that ids' hashes choose, as many of each language as there are.

    One count for each language reaches the driver.
    """
    lang, text = named(rows, lang_column), named(rows, text_column)
    usable = rows.select(lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(named(rows, id_column), F.lit("sample")).alias("h")).filter("lang is not null")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return usable.select("lang", "text")
    each = max(1, sample_rows // len(counts))
    kept = F.lit(False)
    for name, n in counts.items():
        bound = int(min(1.0, each / n) * (1 << 40))
        kept = kept | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 40)) < bound))
    return usable.filter(kept).filter(has_letters(F.col("text"))).select("lang", "text")


def fit(sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Train on a sample (lang, text); the driver gets ``2**FEATURE_BITS / 8`` bytes for each of its rows."""
    rows = sample.mapInArrow(_featurise, "lang string, bits binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.bits)))
    languages = sorted({r.lang for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((1 << FEATURE_BITS, 0), np.float32))

    def vectors(some: list) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return x

    # Only the landmarks' vectors and those of a hundred rows are unpacked at a time.
    y = np.array([[1.0 if r.lang == name else -1.0 for name in languages] for r in rows])
    chosen = np.random.default_rng(7).permutation(len(rows))[:landmarks]
    marks = vectors([rows[i] for i in chosen])
    to_landmarks = np.concatenate([vectors(rows[low : low + 100]) @ marks.T for low in range(0, len(rows), 100)]).astype(np.float64)
    among = to_landmarks[chosen]
    # Ridge regression in the space the landmarks span: minimise |K w - y|^2 + ridge * n * w' K_mm w.
    left = to_landmarks.T @ to_landmarks + ridge * len(rows) * among + 1e-6 * np.eye(len(chosen))
    weights = np.linalg.solve(left, to_landmarks.T @ y)
    return LanguageModel(languages, marks.T @ weights.astype(np.float32))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    languages, weights = model.value
    for batch in batches:
        names, scores = [], []
        letters = np.asarray(batch.column(1).fill_null(False))
        for grid in _batches(batch.column(2)):
            raw = (grid @ weights) / np.sqrt(np.maximum(grid.sum(axis=1, keepdims=True), 1))
            best = raw.argmax(axis=1)
            names += [languages[b] for b in best]
            likely = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            scores += (1 / likely.sum(axis=1)).tolist()
        names = [n if ok else UNKNOWN for n, ok in zip(names, letters)]
        scores = [float(s) if ok else 0.0 for s, ok in zip(scores, letters)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3, batch.num_columns)), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=[*batch.schema.names[3:], "lang_pred", "score"],
        )


def identify(docs: DataFrame, model: LanguageModel, carried: list[Column], text_column: str = "text") -> DataFrame:
    """The ``carried`` columns of every row with ``lang_pred`` and ``score`` (0 to 1).

    A null text, one without letters and any text under a model without languages is ``und``
    with score 0. Only the text decides; it is read whole and never returned unless carried.
    """
    text = named(docs, text_column)
    if not model.languages:
        return docs.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(F.lit(0).alias("__blank"), has_letters(text).alias("__letters"), text.alias("__text"), *carried)
    schema = T.StructType([*rows.schema.fields[3:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    return rows.mapInArrow(partial(_score, model=shared), schema)


def held_out(id_: Column) -> Column:
    """The third of the rows that is never trained on."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of the labelled rows that are not held out, fitted on at most about ``sample_rows`` of them.

    Rows without a language are not learned from. Rows without an id count as not held out.
    """
    return fit(training_sample(docs.filter(~held_out(named(docs, id_column))), id_column, text_column, lang_column, sample_rows))


def keep_known(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages learned; ``und`` goes.

    Where no language was learned, nothing speaks against a text with letters: all such rows stay.
    """
    columns = [named(docs, c) for c in docs.columns]
    model = train(docs, id_column, text_column, lang_column)
    if not model.languages:
        return docs.filter(has_letters(named(docs, text_column)))
    told = identify(docs, model, [F.struct(*columns).alias("row")], text_column)
    return told.filter(F.col("lang_pred") != UNKNOWN).select("row.*")
