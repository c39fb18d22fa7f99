"""A mix of sources in given proportions from a low-discrepancy schedule.

A source's documents, in a random order that their ids fix, are its stream of words; the stream is
read again from the start when it ends and is cut into blocks of equal length. The schedule has
2**m slots. Slot n stands at the van der Corput point of n, whose binary digits are those of n
reversed, and belongs to the source whose share of [0, 1) covers the point. The k-th slot of a
source takes its k-th block, until its target is met. The mix is these blocks in the order of their
slots, each a run of spans of documents; a document counts with the words of it that lie in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import fresh_name, named, partitions, word_count
from blotter.staging import stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
_CHUNK = 1 << 14
_STREAM_CHUNKS = 4096  # fixed, so that a stream does not depend on the session


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight) with ``target``: the weights' shares of all words, none above ``most`` times its source.

    ``sizes`` has one row for each source. A level is sought such that each target is the lesser
    of weight times level and the bound, and all add up: with the sources in the order of
    bound / weight, the first sources are bound, and the others share what those leave.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", picked).withColumn("bound", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    before, upto = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(upto)
    rows = rows.withColumn("level", level)
    # The first source that the level does not bind sets the level of all after it.
    free = F.min(F.when(F.col("weight") * F.col("level") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(everything)
    rows = rows.withColumn("common", free["level"])
    target = F.least(F.col("bound"), F.col("weight") * F.coalesce("common", F.lit(float("inf"))))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def schedule(quotas: DataFrame, slots_log2: int) -> DataFrame:
    """(source, rank, slot): for each source (with ``low`` and ``high`` of its share of the slots) its slots, ranked.

    The points of the 2**m slots are the multiples of 1 / 2**m, so the slots of a source are
    those whose reversed digits lie between two whole numbers. Long stretches are dealt out in
    chunks; a slot's rank is its place in its chunk of slots after the chunks before it.
    """
    chunk = F.explode(F.sequence(F.floor(F.col("low") / _CHUNK), F.floor((F.col("high") - 1) / _CHUNK)))
    dealt = quotas.filter("high > low").withColumn("chunk", chunk).repartition(partitions(quotas.sparkSession), "source", "chunk")
    points = dealt.select(
        "source", F.explode(F.sequence(F.greatest("low", F.col("chunk") * _CHUNK), F.least(F.col("high"), (F.col("chunk") + 1) * _CHUNK) - 1)).alias("point")
    )
    digits = F.lpad(F.bin("point"), slots_log2, "0") if slots_log2 else F.lit("0")
    slots = points.select("source", F.conv(F.reverse(digits), 2, 10).cast("long").alias("slot")).withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("of"), F.col("chunk").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = slots.withColumn("place", F.row_number().over(within) - 1)
    joined = ranked.join(starts, ranked["source"].eqNullSafe(starts["of"]) & (ranked["chunk"] == starts["in"]))
    return joined.select("source", (F.col("start") + F.col("place")).alias("rank"), "slot")


def _streams(rows: DataFrame) -> DataFrame:
    """Where each document's words begin in its source's stream (``begin``)."""
    spread = rows.withColumn("order", F.xxhash64("doc_id", F.lit("mix"))).withColumn("chunk", F.pmod("order", F.lit(_STREAM_CHUNKS)))
    within = Window.partitionBy("source", "chunk").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("of"), F.col("chunk").alias("in"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    placed = spread.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(starts, placed["source"].eqNullSafe(starts["of"]) & (placed["chunk"] == starts["in"]))
    return joined.select("doc_id", "tie", "source", "size", (F.col("start") + F.col("inside")).alias("begin"))


def _mixed(
    docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...], most: int, block_words: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sizes, the sources with their targets, and the spans of documents in the mix."""
    narrow = docs.select(
        named(docs, id_column).alias("doc_id"), F.xxhash64(named(docs, text_column)).alias("tie"), named(docs, source_column).alias("source"), word_count(named(docs, text_column)).alias("size")
    )
    rows = stage(narrow, "sized")
    sources = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    # Numbers that fix the schedule: the quotas of blocks, one row for each source, stay in Spark.
    quotas = sources.withColumn("words", F.floor("target").cast("long")).withColumn("quota", F.ceil(F.col("words") / block_words).cast("long"))
    blocks = quotas.agg(F.sum("quota")).first()[0] or 0
    slots_log2 = max(0, int(blocks - 1).bit_length()) if blocks else 0
    order = Window.orderBy(F.col("source").isNull(), "source")
    upto = F.sum("quota").over(order)
    scale = (1 << slots_log2) / max(1, blocks)
    bounds = quotas.withColumn("low", F.ceil((upto - F.col("quota")) * scale).cast("long")).withColumn("high", F.ceil(upto * scale).cast("long"))
    bounds = stage(bounds, "quotas")
    slots = schedule(bounds.select("source", "low", "high"), slots_log2)
    ends = bounds.select(F.col("source").alias("whose"), "quota", "words")
    used = slots.join(ends, slots["source"].eqNullSafe(ends["whose"])).filter("rank < quota")
    # A block of the stream that is read again and again: [begin, end) in words, the last cut at the target.
    blocks_taken = used.select("slot", "source", F.col("rank").alias("block"), F.least((F.col("rank") + 1) * block_words, F.col("words")).alias("end"))

    placed = _streams(rows.filter("size > 0"))
    wanted = bounds.select(F.col("source").alias("whose"), "source_size", "words")
    copies = placed.join(wanted, placed["source"].eqNullSafe(wanted["whose"]))
    passes = F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))
    copies = copies.withColumn("pass", F.explode(passes)).withColumn("from", F.col("begin") + F.col("pass") * F.col("source_size")).filter("from < words")
    cut = F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words))
    parts = copies.select("doc_id", "tie", F.col("source").alias("own"), "from", "size", F.explode(cut).alias("part"))
    met = parts.join(blocks_taken, parts["own"].eqNullSafe(blocks_taken["source"]) & (parts["part"] == blocks_taken["block"]))
    first, end = F.greatest(F.col("from"), F.col("part") * block_words), F.least(F.col("from") + F.col("size"), F.col("end"))
    return rows, sources, met.filter(end > first).select(
        "slot", "source", "block", "doc_id", "tie", (first - F.col("from")).alias("begin"), (end - first).alias("words"), first.alias("at")
    )


def mix_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix: ``slot``, ``source``, ``block`` of the source, ``at`` (word of its stream), id, ``tie`` (a hash of the text), ``begin``, ``words``.

    In the order of ``slot``, then ``at``, the spans are the mix from first to last; every stretch
    of it has the sources in nearly their proportions. A span is ``words`` words of the document
    from its word ``begin`` (from 0). Slots left out belong to sources whose target is met.
    """
    spans = _mixed(docs, id_column, text_column, source_column, weights, most, block_words)[2]
    return spans.select("slot", "source", "block", "at", F.col("doc_id").alias(id_column), "tie", "begin", "words")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, ``tie`` (a hash of its text), ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``first_slot``.

    Null is a source of its own, the last. A document without words has size 0 and is not taken.
    Each source's ``taken`` add up to its target, rounded down; ``first_slot`` is the slot of the mix
    that a document first appears in, null if it is not taken. Rows that repeat an id are told
    apart by text; equal rows are taken in an order left open, with the same numbers as a set.
    """
    rows, sources, spans = _mixed(docs, id_column, text_column, source_column, weights, most, block_words)
    # Equal rows share an id and text: each document counts by its own first place in the stream.
    sums = spans.groupBy("doc_id", "tie", "source").agg(F.sum("words").alias("sum"), F.min("slot").alias("first_slot"))
    sums = sums.select(F.col("doc_id").alias("of"), F.col("tie").alias("by"), F.col("source").alias("own"), "sum", "first_slot")
    repeats = Window.partitionBy("doc_id", "tie", "source")
    counted = rows.withColumn("rows", F.count("*").over(repeats)).withColumn("nth", F.row_number().over(repeats.orderBy("size")))
    same = counted["doc_id"].eqNullSafe(sums["of"]) & counted["tie"].eqNullSafe(sums["by"]) & counted["source"].eqNullSafe(sums["own"])
    told = counted.join(sums, same, "left").withColumn("all", F.coalesce("sum", F.lit(0)))
    share = F.floor(F.col("all") / F.col("rows")) + F.when(F.col("nth") <= F.col("all") % F.col("rows"), 1).otherwise(0)
    told = told.select("doc_id", "tie", "source", "size", share.cast("long").alias("taken"), F.when(share > 0, F.col("first_slot")).alias("first_slot"))
    facts = sources.select(F.col("source").alias("whose"), "source_size", "target")
    return told.join(facts, told["source"].eqNullSafe(facts["whose"])).select(
        F.col("doc_id").alias(id_column), "tie", "source", "size", "source_size", "target", "taken", "first_slot"
    )


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings) -> DataFrame:
    """The rows of the mix: each document as often as the nearest whole number to its taken share, whole."""
    told = mix(docs, id_column, text_column, source_column, **settings).filter("taken > 0")
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    chosen = told.groupBy(id_column, "tie", "source").agg(F.first(times).alias("__times")).filter("__times > 0")
    chosen = chosen.select(F.col(id_column).alias("__id"), F.col("tie").alias("__by"), F.col("source").alias("__of"), "__times")
    tie = fresh_name(docs, "tie")
    own = docs.withColumn(tie, F.xxhash64(named(docs, text_column)))
    match = named(own, id_column).eqNullSafe(F.col("__id")) & (F.col(tie) == F.col("__by")) & named(own, source_column).eqNullSafe(F.col("__of"))
    joined = own.join(chosen, match).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return joined.select(*[named(joined, c) for c in docs.columns])
