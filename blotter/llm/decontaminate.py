"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item; an item of fewer words is one window. Of every
``span - GRAM + 1`` consecutive word grams the one of the least number (of ties the first) is kept,
in items and in documents, so a shared window has a kept gram in common at the same place. A
document gram that may be an item's kept gram is extended to the windows around it; those that may
be item windows leave the task. "May be" is asked of a bit table of fixed size, broadcast with the
task whatever the benchmark's size; what it lets through is joined with the items' windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.tables import fresh_name, named
from blotter.llm.tokens import NOT_ALPHANUMERIC, grams, mixed, pieces
from blotter.staging import stage

SPAN = 13
GRAM = 5
TABLE_BITS = 25  # 4 MB: fixed, so that what a task carries does not grow with the benchmark

_ITEM = "item_key long, length int, windows array<long>, kept array<long>"
_DOCUMENT = "doc_id {id}, text_key binary, n_words long, hits array<struct<at:int,length:int,window:long>>"


def _kept(numbers: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least number of every ``window`` consecutive ones, each once."""
    if len(numbers) < window:
        return np.arange(0)
    views = np.lib.stride_tricks.sliding_window_view(numbers, window)
    return np.unique(np.concatenate([views[a : a + 65536].argmin(axis=1) + np.arange(a, min(a + 65536, len(views))) for a in range(0, len(views), 65536)]))


def _slots(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit table for each number."""
    again = mixed(numbers ^ np.uint64(0x5851F42D4C957F2D))
    return numbers >> np.uint64(64 - TABLE_BITS), again >> np.uint64(64 - TABLE_BITS)


def _may_hold(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    found = np.ones(len(numbers), dtype=bool)
    for slot in _slots(numbers):
        found &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for piece in pieces(batch.column(1), NOT_ALPHANUMERIC):
            for i in range(len(piece)):
                words = piece.words[piece.offsets[i] : piece.offsets[i + 1]]
                length = min(span, len(words))
                kept = np.zeros(0, np.uint64)
                if length == span:
                    every = grams(words, GRAM)
                    kept = np.unique(every[_kept(every, span - GRAM + 1)])
                windows = np.unique(grams(words, length)) if length else kept
                rows.append((length, windows.view(np.int64).tolist(), kept.view(np.int64).tolist()))
        lengths, windows, kept = zip(*rows) if rows else ((), (), ())
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int32()), pa.array(windows, many), pa.array(kept, many)],
            names=["item_key", "length", "windows", "kept"],
        )


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers to the bytes of their bits in the table: (byte, value)."""
    table = np.zeros(1 << TABLE_BITS >> 3, dtype=np.uint8)
    for batch in batches:
        numbers = np.asarray(batch.column(0)).view(np.uint64)
        for slot in _slots(numbers):
            np.bitwise_or.at(table, slot >> np.uint64(3), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at].astype(np.int64))], names=["byte", "value"])


def _table(numbers: DataFrame) -> np.ndarray:
    """The bit table of a column of numbers; the driver gets each byte once, so at most its size."""
    rows = numbers.mapInArrow(_bits, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << TABLE_BITS >> 3, dtype=np.uint8)
    table[np.asarray(rows.column("byte"))] = np.asarray(rows.column("value"))
    return table


def _scan(batches: Iterator[pa.RecordBatch], span: int, lengths: list[int], kept_bits, window_bits) -> Iterator[pa.RecordBatch]:
    """Each document's word count and the windows that may be an item's."""
    reach = span - GRAM
    kept_bits, window_bits = kept_bits.value, window_bits.value
    for batch in batches:
        counts, ends, columns = [], [0], ([], [], [])
        for piece in pieces(batch.column(2), NOT_ALPHANUMERIC):
            counts.append(np.diff(piece.offsets))
            begins, found = piece.offsets[:-1], []
            owner = np.repeat(np.arange(len(piece)), np.diff(piece.offsets))
            stop = piece.offsets[1:][owner] if len(owner) else owner
            if span in lengths and len(piece.words) >= GRAM:
                # Each window of grams chooses by itself, so those within a row choose as in an item;
                # what windows across rows choose is dropped with them below.
                every = grams(piece.words, GRAM)
                at = _kept(every, reach + 1)
                at = at[_may_hold(kept_bits, every[at])]
                if len(at):
                    starts = np.unique((at[:, None] - np.arange(reach + 1)[None, :]).ravel())
                    found.append((starts[starts >= 0], span))
            for length in lengths:
                if length < span:
                    found.append((np.arange(max(0, len(piece.words) - length + 1)), length))
            rows, ats, sizes, numbers = [], [], [], []
            for starts, length in found:
                starts = starts[starts + length <= len(piece.words)]
                starts = starts[starts + length <= stop[starts]]
                if not len(starts):
                    continue
                starts = np.unique(starts)
                number = grams(piece.words, length)[starts]
                good = _may_hold(window_bits, number)
                starts, number = starts[good], number[good]
                rows.append(owner[starts])
                ats.append(starts - begins[owner[starts]])
                sizes.append(np.full(len(starts), length))
                numbers.append(number)
            if rows:
                rows, ats, sizes, numbers = map(np.concatenate, (rows, ats, sizes, numbers))
                order = np.lexsort((numbers, sizes, ats, rows))
                tally = np.bincount(rows, minlength=len(piece))
                for column, values in zip(columns, (ats, sizes, numbers.view(np.int64))):
                    column.append(values[order])
            else:
                tally = np.zeros(len(piece), np.int64)
            ends.extend((ends[-1] + np.cumsum(tally)).tolist())
        at, size, number = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        hits = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(number, pa.int64())], names=["at", "length", "window"])
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
            names=["doc_id", "text_key", "n_words", "hits"],
        )



def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    span: int = SPAN,
) -> DataFrame:
    """One row per document: its id, ``text_key``, ``n_words``, ``n_hit`` and the sorted ``item_ids`` (as strings).

    Words are runs of letters, digits and other characters beyond ASCII, A-Z lower-cased. A word
    is hit inside an occurrence of a window of an item. A null, empty or wordless text has no
    words and no hits; an item without words has no window; an item without an id marks hits but
    is not listed. Rows that repeat an id are told apart by text; equal rows get equal results.
    An empty benchmark hits nothing. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    items = benchmark.select(named(benchmark, item_column).cast("string").alias("item_id"), named(benchmark, item_text_column).alias("text"))
    items = items.withColumn("item_key", F.xxhash64("text"))
    # Items of one text are one item of the search; their ids come in again at the end.
    texts = items.dropDuplicates(["item_key"]).select("item_key", "text")
    cut = stage(texts.mapInArrow(partial(_windows, span=span), _ITEM), "items")
    lengths = [r.length for r in cut.select("length").filter("length > 0").distinct().collect()]  # span values at most
    carried = [spark.sparkContext.broadcast(_table(cut.select(F.explode(c)))) for c in ("kept", "windows")]
    narrow = docs.select(
        named(docs, id_column).alias("doc_id"), F.unhex(F.md5(F.coalesce(named(docs, text_column), F.lit("")))).alias("text_key"), named(docs, text_column).alias("text")
    )
    scan = partial(_scan, span=span, lengths=lengths, kept_bits=carried[0], window_bits=carried[1])
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scanned = stage(narrow.mapInArrow(scan, _DOCUMENT.format(id=kind)), "scanned")

    windows = cut.select("item_key", "length", F.explode("windows").alias("window"))
    hits = scanned.filter(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("hit"))
    hits = hits.select("doc_id", "text_key", "hit.*").distinct().join(windows, ["length", "window"])
    marks = stage(hits.select("doc_id", "text_key", "at", "length", "item_key"), "hits")
    key = ["doc_id", "text_key"]
    covered = marks.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", F.expr("at + length").alias("end")))).alias("spans"))
    reach = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["at"]))).cast("long").alias("n"),
        ),
    )
    ids = items.filter("item_id is not null").select("item_key", "item_id").distinct()
    listed = marks.select(*key, "item_key").distinct().join(ids, "item_key").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = covered.select(*key, reach["n"].alias("n_hit")).join(listed.withColumnRenamed("doc_id", "same_id").withColumnRenamed("text_key", "same_key"), F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("text_key") == F.col("same_key")), "left")
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_hit", "item_ids")
    told = scanned.select(*key, "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return told.select(
        F.col("doc_id").alias(id_column),
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is contaminated if benchmark passages make up a twentieth of its words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, repeated rows and rows without an id included."""
    told = contamination(docs, benchmark, id_column, text_column).filter(contaminated())
    bad = told.select(F.col(id_column).alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    key = fresh_name(docs, "text_key")
    own = docs.withColumn(key, F.unhex(F.md5(F.coalesce(named(docs, text_column), F.lit("")))))
    match = named(own, id_column).eqNullSafe(F.col("__bad_id")) & (F.col(key) == F.col("__bad_key"))
    return own.join(bad, match, "left_anti").select(*[named(own, c) for c in docs.columns])
