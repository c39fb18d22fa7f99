"""Phrases that occur often, by dynamic itemset counting, and how strongly their words belong together.

The texts are spread over ``SHARDS`` shards that are scanned in turn, again and again; one scan of a
shard is a step. Words are counted in the first cycle. A longer phrase is activated when both
phrases of one word less, its beginning and its end, have reached the threshold, in whatever part
of their cycle they are; it is counted from the next step on, for one whole cycle. So lengths are
counted side by side, and the scans end when no phrase that has reached the threshold is younger
than a cycle. Any ``SHARDS`` consecutive steps see every shard once, so their sum never
exceeds a phrase's true count, and it is that count when the phrase's cycle ends.

A phrase is a 64-bit number (three bits of which are its length) until its count is known, and a
task gives one count for each. A task learns what is active from two bit tables (of bounded size)
over the phrases that have reached the threshold: all of them, and those of the last cycle. What the
tables let through by chance is counted too, which costs time but changes no result. At the end
the numbers found are told in words: by a part of the texts, in which most of them occur, and
those still missing by the others.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces
and tabs. Null texts are empty, a null language is ``und``; every row counts, copies too. A text of
any length is read a megabyte at a time. Other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.tables import discard, named
from blotter.llm.tokens import _words_of, grams, mixed, numbers, text_bytes
from blotter.operators.positions import with_position
from blotter.staging import shuffles_deleted, stage

THRESHOLD = 100
LONGEST = 5
SHARDS = 2
TELLERS = 16  # a part of the texts out of so many tells most phrases
UNKNOWN = "und"
WINDOW = 1_000_000  # bytes that are numbered at once
HELD = 3_000_000  # occurrences that a task holds before it gives their counts, and
TOLD = 200_000  # phrases that it holds in words
FEW_LANGUAGES = 10_000  # so many totals are broadcast
SLICE_ROWS = 8_000_000  # counts that are summed at once, but in at most
MOST_SLICES = 8
_LEAST_BITS, _MOST_BITS, _BITS_EACH = 20, 27, 32

BREAKS = b".,;:!?\n\x0b\x0c\r"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(BREAKS + b" \t")] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_NUMBERS = "number long, occurrences long, first boolean"
_TOLD = "number long, lang string, words int, phrase string"


# --- one task ---------------------------------------------------------------------


def windows(data: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, word starts, word ends, word numbers, piece of each word, first new word), about ``WINDOW`` bytes at a time.

    A window begins with the last ``LONGEST - 1`` words of the one before, which are not new.
    """
    at, carried = 0, b""
    while at < len(data):
        stop = min(len(data), at + WINDOW)
        while stop < len(data):  # to the next separator
            more = np.frombuffer(data, np.uint8, min(WINDOW, len(data) - stop), stop)
            found = np.flatnonzero(_SEPARATOR[more])
            stop += int(found[0]) + 1 if len(found) else len(more)
            if len(found):
                break
        part = carried + data[at:stop]
        at, seen = stop, np.frombuffer(part, np.uint8)
        first, number = _words_of(seen, np.zeros(1, np.int64), _SEPARATOR)
        outside = np.append(_SEPARATOR[seen], True)
        ends = np.flatnonzero(outside[1:] > outside[:-1]) + 1
        breaks = np.cumsum(_BREAK[seen], dtype=np.int32)
        piece = breaks[first]
        new = int(np.searchsorted(first, len(carried)))
        yield part, first, ends, number, piece, new
        # The last words again, with one separator each: a break where there was one between them.
        carried = b""
        for i in range(max(0, len(first) - LONGEST + 1), len(first)):
            after = breaks[first[i + 1]] if i + 1 < len(first) else breaks[-1]
            carried += part[first[i] : ends[i]] + (b"." if after > breaks[first[i]] else b" ")


def language_number(lang: str) -> np.uint64:
    data = lang.encode()
    return mixed(numbers(1, zlib.crc32(data) << 32 | zlib.adler32(data)))[0]


def numbered(words: np.ndarray, n: int, own: np.uint64) -> np.ndarray:
    """The number of every run of ``n`` words in a language; its last three bits are ``n``."""
    number = (words if n == 1 else grams(words, n)) ^ own
    return (number & ~np.uint64(7)) | np.uint64(n)


def total_number(own: np.uint64) -> np.uint64:
    """What counts all words of a language."""
    return own & ~np.uint64(7)


def _slots(number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bit table for each number."""
    one = mixed(number ^ np.uint64(0x2545F4914F6CDD1D))
    return one >> np.uint64(64 - bits), mixed(one) >> np.uint64(64 - bits)


def _holds(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def _held(table: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the table holds the numbers, and the places of those; the second place is worked out where the first is set."""
    one = mixed(number ^ np.uint64(0x2545F4914F6CDD1D))
    slot = one >> np.uint64(64 - bits)
    at = np.flatnonzero(_holds(table, slot))
    other = mixed(one[at]) >> np.uint64(64 - bits)
    both = _holds(table, other)
    return at[both], slot[at[both]], other[both]


def _set(table: np.ndarray, slots: tuple[np.ndarray, ...]) -> None:
    for slot in slots:
        np.bitwise_or.at(table, slot >> np.uint64(3), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))


def active_phrases(window: tuple, own: np.uint64, tables: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, positions, numbers, which are new) of the longer phrases whose two shorter ones are held, one of them as recent.

    A phrase is new in the step after the one in which the later of its shorter ones reached the threshold.
    """
    _, _, _, words, piece, new = window
    reached, recent, newest, bits = tables
    shorter = numbered(words, 1, own)
    for n in range(2, LONGEST + 1):
        places = len(words) - n + 1
        if places <= 0:
            return
        held, *slots = _held(reached, shorter, bits)
        young, latest = (np.logical_and(*(_holds(table, slot) for slot in slots)) for table in (recent, newest))
        shorter = numbered(words, n, own)
        # Both shorter phrases are held: their places follow one another.
        pair = np.flatnonzero((held[1:] - held[:-1] == 1) & (young[1:] | young[:-1]))
        at = held[pair]
        fits = (piece[at] == piece[at + n - 1]) & (at > new - n)
        pair, at = pair[fits], at[fits]
        yield n, at, shorter[at], latest[pair] | latest[pair + 1]


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
    """The windows of (lang, text) rows, a few megabytes of one language at a time."""
    for batch in batches:
        offsets, data = text_bytes(batch.column(1))
        by_lang: dict[str, list[tuple[int, int]]] = {}
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            by_lang.setdefault(lang, []).append((a, b))
        for lang, spans in by_lang.items():
            low = 0
            while low < len(spans):
                high, size = low, 0
                while high < len(spans) and size < WINDOW:
                    size += spans[high][1] - spans[high][0] + 1
                    high += 1
                for window in windows(b"\n".join(data[a:b].tobytes() for a, b in spans[low:high]).translate(_LOWER)):
                    yield lang, window
                low = high


def _stepped(batches: Iterator[pa.RecordBatch], step: int, shards: int, tables) -> Iterator[pa.RecordBatch]:
    """One step over a part of a shard: counts by number, among them of all words of a language, and whether it is the number's first step."""
    tables, singles = None if tables is None else tables.value, step <= shards
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}
    waiting, totals = 0, {}

    def counts() -> Iterator[pa.RecordBatch]:
        for first, found in held.items():
            number, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            if first == (step == 1):
                number, times = np.append(number, np.array(list(totals), np.uint64)), np.append(times, list(totals.values())).astype(np.int64)
            columns = [pa.array(number.view(np.int64)), pa.array(times.astype(np.int64)), pa.repeat(first, len(number))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "occurrences", "first"])
            found.clear()
        totals.clear()

    for lang, window in _windows_of(batches):
        words, new, own = window[3], window[5], language_number(lang)
        found = {True: [], False: []}
        if singles:
            found[step == 1].append(numbered(words[new:], 1, own))
            totals[total_number(own)] = totals.get(total_number(own), 0) + len(words) - new
        if tables is not None:
            for *_, number, first in active_phrases(window, own, tables):
                found[True].append(number[first])
                found[False].append(number[~first])
        for first, more in found.items():
            held[first] += more
            waiting += sum(map(len, more))
        if waiting >= HELD:
            yield from counts()
            waiting = 0
    yield from counts()


def _told(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """What the table holds, in words, each once or a few times a task."""
    table, *_, bits = tables.value
    known: dict[int, tuple[str, int, bytes]] = {}

    def given() -> pa.RecordBatch:
        keys = np.array(list(known), np.uint64).view(np.int64)
        columns = [keys, [k[0] for k in known.values()], [k[1] for k in known.values()], [k[2].decode(errors="replace") for k in known.values()]]
        known.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["number", "lang", "words", "phrase"])

    for lang, window in _windows_of(batches):
        part, first, ends, words, piece, _ = window
        own = language_number(lang)
        known.setdefault(int(total_number(own)), (lang, 0, b""))
        for n in range(1, min(LONGEST, len(words)) + 1):
            number = numbered(words, n, own)
            at = _held(table, number, bits)[0]
            at = at[piece[at] == piece[at + n - 1]]
            each, where = np.unique(number[at], return_index=True)
            for value, i in zip(each.tolist(), at[where].tolist()):
                if value not in known:
                    known[value] = (lang, n, b" ".join(part[first[i] : ends[i + n - 1]].split()))
        if len(known) >= TOLD:
            yield given()
    yield given()


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Numbers to the bytes of their bits: (byte, all, recent, newest)."""
    tables = np.zeros((3, 1 << bits >> 3), dtype=np.uint8)
    for batch in batches:
        number = np.asarray(batch.column(0)).view(np.uint64)
        _set(tables[0], _slots(number, bits))
        for table, column in zip(tables[1:], batch.columns[1:]):
            _set(table, _slots(number[column.to_numpy(zero_copy_only=False).astype(bool)], bits))
    at = np.flatnonzero(tables[0])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(t[at].astype(np.int64)) for t in tables)], names=["byte", *_TABLES])


# --- steps ------------------------------------------------------------------------

_TABLES = ("reached", "recent", "newest")


def _tables(reached: DataFrame, entries: int, oldest: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bit tables over all numbers, and over those that reached the threshold in step ``oldest`` or later, and in ``last``."""
    bits = min(max((_BITS_EACH * max(entries, 1)).bit_length(), _LEAST_BITS), _MOST_BITS)
    asked = reached.select("number", (F.col("step") >= oldest).alias("recent"), (F.col("step") >= last).alias("newest"))
    told = asked.mapInArrow(partial(_bits, bits=bits), ", ".join(f"{c} long" for c in ("byte", *_TABLES)))
    rows = told.groupBy("byte").agg(*[F.bit_or(c).alias(c) for c in _TABLES]).toArrow()
    tables = np.zeros((3, 1 << bits >> 3), dtype=np.uint8)
    for table, name in zip(tables, _TABLES):
        table[np.asarray(rows.column("byte"))] = np.asarray(rows.column(name))
    return *tables, bits


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS) -> DataFrame:
    """(lang, words, phrase, occurrences) of all phrases of up to ``LONGEST`` words with that many occurrences.

    The row of no words has the occurrences of all words of the language.
    """
    with shuffles_deleted(docs.sparkSession):
        return _frequent_phrases(docs, threshold, shards)


def _frequent_phrases(docs: DataFrame, threshold: int, shards: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(named(docs, "lang"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(named(docs, "text"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    spread = [F.pmod("row", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.floor(F.col("row") / shards), F.lit(TELLERS)).cast("int").alias("teller")]
    texts = stage(texts.select("lang", "text", *spread[::-1]), "phrase-shards", "shard")
    cycle: list[DataFrame] = []  # the counts of the last steps, at most one of each shard
    reached, entries, youngest, step = None, 0, 0, 0
    while step < shards or youngest > step - shards:
        step += 1
        longer = reached.filter(_words().between(1, LONGEST - 1)) if entries else None
        tables = spark.sparkContext.broadcast(_tables(longer, entries, step - shards, step - 1)) if entries else None
        if len(cycle) == shards:  # summed for the last time in the step before
            discard(cycle.pop(0))
        shard = texts.filter(F.col("shard") == (step - 1) % shards).select("lang", "text")
        counted = stage(shard.mapInArrow(partial(_stepped, step=step, shards=shards, tables=tables), _NUMBERS), f"phrase-counts-{step}")
        cycle.append(counted)
        before, reached = reached, _staged_slices(_reached(cycle, reached, step, threshold, shards), sum(c.count() for c in cycle), f"phrases-reached-{step}")
        if before is not None:
            discard(before)
        entries, youngest = reached.agg(F.count(F.lit(1)), F.coalesce(F.max(F.when(_words().between(1, LONGEST - 1), F.col("step"))), F.lit(0))).first()
        if tables is not None:
            tables.unpersist()
    for counted in cycle:
        discard(counted)
    in_words = _in_words(texts.filter(F.col("teller") == 0), reached, entries, "phrases-told")
    missing = stage(reached.join(in_words, "number", "left_anti"), "phrases-missing")
    others = missing.count()
    if others:
        in_words = in_words.unionByName(_in_words(texts.filter(F.col("teller") != 0), missing, others, "phrases-told-late"))
    return reached.join(in_words, "number").select("lang", "words", "phrase", "occurrences")


def _in_words(texts: DataFrame, reached: DataFrame, entries: int, label: str) -> DataFrame:
    """(number, lang, words, phrase) of the numbers that occur in these texts."""
    tables = texts.sparkSession.sparkContext.broadcast(_tables(reached, entries, 0, 0))
    told = texts.select("lang", "text").mapInArrow(partial(_told, tables=tables), _TOLD)
    one = told.groupBy("number").agg(F.min(F.struct("lang", "words", "phrase")).alias("p")).select("number", "p.*")
    return stage(one.join(reached.select("number"), "number", "left_semi"), label)


def _reached(cycle: list[DataFrame], before: DataFrame | None, step: int, threshold: int, shards: int) -> DataFrame:
    """(number, step, occurrences) of all phrases that the last cycle or one before found often enough.

    ``step`` is the first that did; the largest sum of any cycle is the phrase's count. Of the first step of a
    whole cycle only new phrases are summed again: the cycle of all others there has ended before. Totals of
    languages (of no words) are kept whatever they are.
    """
    counts = [cycle[0].filter("first") if len(cycle) == shards else cycle[0], *cycle[1:]]
    rows = reduce(DataFrame.unionByName, [counted.select("number", "occurrences", F.lit(None).cast("int").alias("step"), F.lit(0).cast("long").alias("most")) for counted in counts])
    if before is not None:
        rows = rows.unionByName(before.select("number", F.lit(0).cast("long").alias("occurrences"), "step", F.col("occurrences").alias("most")))
    summed = rows.groupBy("number").agg(F.sum("occurrences").alias("now"), F.min("step").alias("step"), F.max("most").alias("most"))
    often = summed.filter(F.col("step").isNotNull() | (F.col("now") >= threshold) | (_words() == 0))
    return often.select("number", F.coalesce("step", F.lit(step)).alias("step"), F.greatest("now", "most").alias("occurrences"))


def _staged_slices(summed: DataFrame, rows: int, label: str) -> DataFrame:
    """What is summed by number, one slice of the numbers after the other, so that only a slice's shuffle lies on disk."""
    slices = min(MOST_SLICES, 1 + rows // SLICE_ROWS)
    own = F.pmod(F.shiftright("number", 3), F.lit(slices))
    return reduce(DataFrame.unionByName, [stage(summed.filter(own == i), label) for i in range(slices)])


def _words() -> Column:
    return F.col("number").bitwiseAND(F.lit(7))


# --- collocations -----------------------------------------------------------------


def _parts(words: int) -> Column:
    """All runs of at least two of the phrase's words that are shorter than it."""
    word = F.split("phrase", " ")
    spans = [(n, i) for n in range(2, words) for i in range(words - n + 1)]
    return F.array_distinct(F.array(*[F.array_join(F.slice(word, i + 1, n), " ") for n, i in spans]))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, most: int = 2000, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` strongest phrases.

    ``a`` is the phrase's count, ``l`` and ``r`` are those of the two parts of its weakest cut, ``n`` all words. A
    phrase goes if a longer one contains it every time.
    """
    with shuffles_deleted(docs.sparkSession):
        return _collocations(docs, threshold, most, shards)


def _collocations(docs: DataFrame, threshold: int, most: int, shards: int) -> DataFrame:
    found = stage(frequent_phrases(docs, threshold, shards), "phrases-frequent")
    every = found.filter("words = 0").select("lang", F.col("occurrences").alias("n"))
    known = found.filter("words > 0").select("lang", "phrase", F.col("occurrences"))
    longer = found.filter("words > 1").select("lang", "words", "phrase", F.col("occurrences").alias("a"))

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    word = F.split("phrase", " ")
    cuts = longer.withColumn("k", cut).withColumns({
        "left": F.array_join(F.slice(word, F.lit(1), F.col("k")), " "),
        "right": F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " "),
    })
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("occurrences").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("occurrences").alias("r")), ["lang", "right"])
    # Whole-number division of decimals: exact up to 10^17 occurrences.
    product = "cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(16,0))"
    few = every.count() <= FEW_LANGUAGES
    scored = cuts.join(F.broadcast(every) if few else every, "lang").withColumn("score", F.expr(f"({product}) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")

    inner = reduce(DataFrame.unionByName, [longer.filter(F.col("words") == n).select("lang", F.explode(_parts(n)).alias("phrase"), "a") for n in range(3, LONGEST + 1)])
    within = inner.groupBy("lang", "phrase").agg(F.max("a").alias("a"))
    kept = weakest.join(within, ["lang", "phrase", "a"], "left_anti")
    ranked = with_position(kept, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], "place", "phrases-ranked", "lang")
    top = ranked.filter(F.col("place") < most)
    return top.select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
