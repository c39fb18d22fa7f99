"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 60-bit key: 30 bits of a hash of the text, so equal texts stand together,
then 30 of a hash of the id, so that a text with very many copies can be cut as well. Rounds of
exact counts of the bytes in equal parts of the open key ranges narrow the range of every splitter
until the bytes below it are within the tolerance of its target. Rows then move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import fresh_name, named, partitions
from blotter.staging import stage

SHARDS = 40
OVERHEAD = 16
_KEY_BITS, _FIRST_BITS, _MORE_BITS = 60, 12, 8


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed part for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def sort_key(text: Column, id_: Column) -> Column:
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0x3FFFFFFF))
    low = F.xxhash64(id_, F.lit(1)).bitwiseAND(F.lit(0x3FFFFFFF))
    return F.shiftleft(high, 30).bitwiseOR(low)


def splitters(sized: DataFrame, key: str, size: str, targets: list[int], tolerance: int) -> list[int]:
    """For each target the key such that the bytes below it miss the target by ``tolerance`` or by less than a key's bytes.

    Each round counts exactly, over all rows of the open ranges; the driver gets one number for
    each of 2**12 parts at first, then of 2**8 parts of each open range, whatever the number of rows.
    """
    rows = sized.select(F.col(key).alias("key"), F.col(size).alias("size"))
    done: dict[int, int] = {}
    open_ = {t: (0, 0) for t in targets}  # target -> first key of its range, bytes below that
    width, shift = _KEY_BITS, _KEY_BITS - _FIRST_BITS
    while open_:
        ranges = sorted({first >> width for first, _ in open_.values()})
        inside = rows.filter(F.shiftright("key", width).isin(ranges))
        counts = inside.groupBy(F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("bytes")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(counts):
            by_range.setdefault(r.part << shift >> width, []).append(r)
        for target, (first, below) in list(open_.items()):
            for r in by_range.get(first >> width, []):
                if below + r.bytes > target:
                    first = r.part << shift
                    if shift == 0 and below + r.bytes - target < target - below:
                        first += 1  # the key's bytes fit better below than above
                        below = target
                    break
                below += r.bytes
                first = (r.part + 1) << shift
            if target - below <= tolerance or shift == 0:
                done[target] = first
                del open_[target]
            else:
                open_[target] = (first, below)
        width, shift = shift, shift - _MORE_BITS
    return [done[t] for t in targets]


def _place(key: Column, splits: list[int], low: int = 0) -> Column:
    """How many of the sorted ``splits`` are at most ``key``, by halving."""
    if not splits:
        return F.lit(low)
    middle = len(splits) // 2
    return F.when(key < splits[middle], _place(key, splits[:middle], low)).otherwise(_place(key, splits[middle + 1 :], low + middle + 1))


def shard(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", tolerance: float = 0.001) -> DataFrame:
    """All columns and rows of ``docs`` with ``size`` (of the text), ``shard`` and ``slot``, moved once.

    Every shard holds the same bytes, but for ``tolerance`` of a shard or one row. Slots count
    from 0 without gaps in every shard; equal texts follow one another. Null and empty texts are
    alike and have the size of an empty text; repeated rows are rows of their own. Result columns
    that ``docs`` has already get a leading underscore. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key, size, part, shard_, slot = (fresh_name(docs, c) for c in ("__key", "size", "__part", "shard", "slot"))
    text, id_ = named(docs, text_column), named(docs, id_column)
    sized = docs.select("*", sort_key(text, id_).alias(key), text_size(text).alias(size))
    narrow = stage(sized.select(F.col(key).alias("key"), F.col(size).alias("size")), "sizes")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    # Each shard is exchanged in several parts, so that no task holds a shard.
    pieces = max(1, -(-2 * partitions(spark) // shards))
    count = shards * pieces
    targets = [total * i // count for i in range(1, count)]
    found = splitters(narrow, "key", "size", sorted(set(targets)), int(tolerance * total / max(1, shards))) if total else []
    by_target = dict(zip(sorted(set(targets)), found))
    splits = [by_target[t] for t in targets] if total else []
    counts = narrow.groupBy(_place(F.col("key"), splits).alias("part")).agg(F.count("*").alias("n")).collect()
    rows_of = {r.part: r.n for r in counts}
    starts, running = [], 0
    for p in range(count):
        running = 0 if p % pieces == 0 else running
        starts.append(running)
        running += rows_of.get(p, 0)
    placed = sized.withColumn(part, _place(F.col(key), splits)) if splits else sized.withColumn(part, F.lit(0))
    order = Window.partitionBy(part).orderBy(key, named(placed, id_column))
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(part) + 1)
    ranked = placed.withColumn(slot, start + F.row_number().over(order) - 1)
    ranked = ranked.withColumn(shard_, F.floor(F.col(part) / pieces).cast("int"))
    return ranked.select(*[named(ranked, c) for c in docs.columns], size, shard_, slot)
