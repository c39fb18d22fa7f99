"""The prefix trie of conversations, from the neighbours of their sorted order.

A conversation is the sequence of its turns' digests. Conversations are range-partitioned and sorted
by that sequence, so that those with a common beginning are neighbours, and the common length of two
neighbours (LCP) is an edge between them. In each partition the edges are taken in descending
depth by union-find: a merge of two components at depth ``d`` makes the branching node of depth
``d``; a component that is deeper than the merge closes first, and gives the nodes down to it.

What may still grow over a partition's border is left open: the components at the first and the
last conversation, and beside them those that hang on an open one. They are the partition's
contracted forest, as many as there are branches along two conversations. Contracted forests of
``FAN`` neighbouring partitions are merged in the same way, round after round, until one is left.
A node that closes before its parent knows the parent's reference, which later rounds resolve.

Rows without a conversation's id are left out; null roles and texts are empty; a null turn stands
first; rows of one turn stand in the order of their digests. Repeated rows are turns of their own.
Ids must be whole numbers of 64 bits. An empty table has no nodes, not even the root. The digests
of one conversation (32 characters a turn) are one row; the members of a node never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import named
from blotter.staging import stage

DIGEST = 32  # characters of a turn's digest
FAN = 32  # contracted forests that one task merges
SHARED = 5  # conversations that begin alike, and
HEAD = 8  # the most turns they share

_ROWS = (
    "part long, seq int, conv_id long, depth long, parent long, ref string, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends string, open boolean, edge long, key string, sizes array<long>, kind string"
)
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


# --- conversations as sequences -------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """A turn's role and text in ``DIGEST`` hexadecimal characters."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, DIGEST)


def _steps(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(named(turns, c), F.lit("")) for c in ("role", "text"))
    conv = named(turns, "conv_id").cast("long")
    return turns.select(
        conv.alias("conv_id"),
        F.struct(named(turns, "turn").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("step"),
    ).filter("conv_id is not null")


def _sequences(ordered: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the digests in one string, and the bytes of every turn's text."""
    return ordered.select(
        "conv_id",
        F.array_join(F.transform("steps", lambda s: s["digest"]), "").alias("key"),
        F.transform("steps", lambda s: s["size"]).alias("sizes"),
    )


def sequences(turns: DataFrame) -> DataFrame:
    """Every conversation's turns in order, as (conv_id, key, sizes)."""
    return _sequences(_steps(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps")))


def rebuilt_sequences(turns: DataFrame) -> DataFrame:
    """As :func:`sequences`, with shared beginnings.

    Of every ``SHARED`` consecutive ids the first gives its beginning to all: conversation c has
    the first h turns of conversation c - c % 5 and then its own after its first h, where h is
    crc32 of c in decimal modulo 9 (% as in SQL). The five are exchanged to one place, once.
    """
    steps = _steps(turns)
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    each = steps.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("steps", 1, HEAD))
    head = F.first(first, ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    both = each.select("conv_id", "steps", F.coalesce(head, F.slice("steps", 1, 0)).alias("head"), h.alias("h"))
    return _sequences(both.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("steps", F.col("h") + 1, F.size("steps"))).alias("steps")))


# --- forests ----------------------------------------------------------------------


class _Node:
    """A trie node while its subtree grows; nodes found to be one and the same point to one of them."""

    __slots__ = ("up", "conv", "depth", "ref")

    def __init__(self, ref: str | None = None):
        self.up, self.conv, self.depth, self.ref = None, None, None, ref

    def top(self) -> _Node:
        node = self
        while node.up is not None:
            node = node.up
        return node


@dataclass(slots=True)
class _Part:
    """A component: conversations that are neighbours and share ``depth`` turns, whose bytes are ``sizes``."""

    depth: int
    n: int
    low: int
    sizes: np.ndarray
    ends: str | None = None
    open: bool = False  # members that end here may stand in other partitions too
    children: int = 0
    leaves: int = 0  # below its children
    saved: int = 0
    node: _Node = field(default_factory=_Node)


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def contract(parts: list[_Part], edges: list[int], whole: bool, closed: list[tuple]) -> tuple[list[_Part], list[int]]:
    """Merge neighbours in descending depth of the ``edges`` between them; what is left, and the edges between that.

    Unless this is the ``whole`` table, the first and the last component may go on outside, so
    nothing at or below their depth on that side is settled: an edge below the depth at which a
    component is open stays, and its other end is open at that edge from then on. Chains of
    nodes that are settled are appended to ``closed``.
    """
    count = len(parts)
    up = list(range(count))
    left, right = [-1] * count, [-1] * count  # depth at which a component is open on that side
    if not whole:
        left[0], right[-1] = parts[0].depth, parts[-1].depth

    def lower(part: _Part, floor: int) -> None:
        if part.depth > floor:
            above = _Node()
            closed.append((part.low, floor, part.depth, part.n, part.children, part.leaves or 1, part.saved, part.ends, part.open, part.sizes[max(floor, 0) : part.depth], above))
            part.node.top().conv, part.node.top().depth = part.low, part.depth
            part.saved += (part.n - 1) * int(part.sizes[max(floor, 0) : part.depth].sum())
            part.children, part.leaves, part.depth = 1, part.leaves or 1, floor
            part.node, part.ends, part.open = above, None, False

    kept = []
    for i in sorted(range(count - 1), key=lambda e: -edges[e]):
        depth, a, b = edges[i], _find(up, i), _find(up, i + 1)
        stuck_a, stuck_b = left[a] > depth, right[b] > depth
        if not stuck_a:
            lower(parts[a], depth)
        if not stuck_b:
            lower(parts[b], depth)
        if stuck_a or stuck_b:
            kept.append(i)
            if not stuck_b:
                left[b] = depth
            if not stuck_a:
                right[a] = depth
            continue
        one, other = parts[a], parts[b]
        up[b] = a
        right[a] = right[b]
        one.n += other.n
        one.low = min(one.low, other.low)
        one.children += other.children
        one.leaves += other.leaves
        one.saved += other.saved
        one.ends = one.ends or other.ends
        one.open = one.open or other.open
        mine, its = one.node.top(), other.node.top()
        if mine is not its:
            mine.ref = mine.ref or its.ref
            its.up = mine
    if whole:
        root = parts[_find(up, 0)]
        lower(root, 0)
        lower(root, -1)
        return [], []
    kept.sort()
    return [parts[_find(up, i)] for i in [0, *[k + 1 for k in kept]]], [edges[k] for k in kept]


class _Table:
    """Rows of all kinds on their way out."""

    def __init__(self, tag: str):
        self.tag, self.given, self.rows = tag, [], {name: [] for name in _NAMES}

    def add(self, kind: str, **values) -> None:
        for name, column in self.rows.items():
            column.append(kind if name == "kind" else values.get(name))

    def name(self, node: _Node) -> str:
        node = node.top()
        if node.ref is None:
            node.ref = f"{self.tag}.{len(self.given)}"
            self.given.append((node.ref, node))
        return node.ref

    def settle(self, closed: list[tuple]) -> None:
        """The nodes of the closed chains; a parent that is still open is told by reference."""
        for low, floor, depth, n, children, leaves, saved, ends, open_, sizes, above in closed:
            above = above.top()
            parent, ref = (above.conv, None) if above.conv is not None or floor < 0 else (None, self.name(above))
            for d in range(depth, floor, -1):
                if d:
                    saved += (n - 1) * int(sizes[d - 1 - max(floor, 0)])
                last, top = d == depth, d == floor + 1
                self.add(
                    "node", conv_id=low, depth=d, parent=parent if top else low, ref=ref if top else None, n_convs=n, n_children=children if last else 1,
                    n_leaves=leaves, saved_tokens=saved, ends=ends if last else None, open=last and open_,
                )
        closed.clear()

    def forest(self, part: int, parts: list[_Part], edges: list[int], first: str, last: str) -> None:
        for seq, (p, edge) in enumerate(zip(parts, [*edges, None])):
            key = first if seq == 0 else None
            self.add(
                "piece", part=part, seq=seq, conv_id=p.low, depth=p.depth, ref=self.name(p.node), n_convs=p.n, n_children=p.children, n_leaves=p.leaves,
                saved_tokens=p.saved, ends=p.ends, open=p.open, edge=edge, key=key, sizes=p.sizes[: p.depth].tolist(),
            )
        self.add("last", part=part, key=last)

    def aliases(self) -> None:
        """Where every reference given so far has gone, if it no longer stands for a component."""
        for ref, node in self.given:
            top = node.top()
            if top.conv is not None:
                self.add("alias", ref=ref, conv_id=top.conv, depth=top.depth)
            elif top.ref != ref:
                self.add("alias", ref=ref, key=top.ref)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, {name: [] for name in _NAMES}
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _ROWS.split(", ")])


def common_turns(a: str, b: str) -> int:
    """How many turns two sequences begin with in common."""
    if a == b:
        return len(a) // DIGEST
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return (int(differ[0]) if len(differ) else n) // DIGEST


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, np.ndarray, list[int]]], bool]]:
    """Equal sequences with the ids of their conversations, some at a time; the last one alone, with a mark."""
    held = None
    for batch in batches:
        groups = []
        sizes = batch.column(2)
        for i, (conv, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if held is not None and held[0] == key:
                held[2].append(conv)
                continue
            if held is not None:
                groups.append(held)
            held = (key, np.asarray(sizes[i].values if sizes[i].is_valid else [], dtype=np.int64), [conv])
        if groups:
            yield groups, False
    if held is not None:
        yield [held], True


def _listed(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The settled nodes of a sorted partition and its contracted forest."""
    number = TaskContext.get().partitionId()
    table, parts, edges, first, last, closed = _Table(f"0.{number}"), [], [], None, None, []
    for groups, at_end in _groups(batches):
        for key, sizes, ids in groups:
            if last is not None:
                edges.append(common_turns(last[0], key))
            part = _Part(len(sizes), len(ids), min(ids), sizes, hashlib.sha256(_listed(ids).encode()).hexdigest(), open=first is None or at_end)
            parts.append(part)
            last = (key, ids, part)
            first = first or last
        parts, edges = contract(parts, edges, False, closed)
        table.settle(closed)
        yield table.batch()
    if first is None:
        return
    # Neighbouring partitions may hold more conversations of the first and of the last sequence.
    for seq, (_, ids, part) in enumerate([first, last] if first is not last else [first]):
        table.add("ends", ref=table.name(part.node), part=number, seq=seq, key=_listed(ids))
    table.forest(number, parts, edges, first[0], last[0])
    table.aliases()
    yield table.batch()


def _merged(rows: pa.Table, tag: str, whole: bool) -> pa.Table:
    """Contracted forests of neighbouring partitions as one."""
    rows = rows.to_pylist()
    group = rows[0]["group"]
    table, parts, edges, closed = _Table(f"{tag}.{group}"), [], [], []
    lasts = {r["part"]: r["key"] for r in rows if r["kind"] == "last"}
    before = first = None
    for r in sorted((r for r in rows if r["kind"] == "piece"), key=lambda r: (r["part"], r["seq"])):
        if r["seq"] == 0 and before is not None:
            edges.append(common_turns(before, r["key"]))
        first = r["key"] if first is None else first
        node = _Node(r["ref"])
        table.given.append((r["ref"], node))
        parts.append(
            _Part(r["depth"], r["n_convs"], r["conv_id"], np.array(r["sizes"], np.int64), r["ends"], r["open"], r["n_children"], r["n_leaves"], r["saved_tokens"], node)
        )
        if r["edge"] is not None:
            edges.append(r["edge"])
        before = lasts[r["part"]]
    parts, edges = contract(parts, edges, whole, closed)
    table.settle(closed)
    if not whole:
        table.forest(group, parts, edges, first, before)
    table.aliases()
    return pa.Table.from_batches([table.batch()])


def _merging(tag: str, whole: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(rows: pa.Table) -> pa.Table:
        return _merged(rows, tag, whole)

    return merge


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the listed ids of each node, which arrive in order."""
    at, hasher = None, None
    for batch in batches:
        out = ([], [], [])
        for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if at != (conv, depth):
                if at is not None:
                    for column, value in zip(out, (*at, hasher.hexdigest())):
                        column.append(value)
                at, hasher = (conv, depth), hashlib.sha256(ids.encode())
            else:
                hasher.update(f",{ids}".encode())
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(out[0], pa.int64()), "depth": pa.array(out[1], pa.int64()), "digest": pa.array(out[2], pa.string())})
    if at is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "digest": pa.array([hasher.hexdigest()], pa.string())})


def _merge_rounds(forests: DataFrame) -> list[DataFrame]:
    """The rows of all rounds, the sorted partitions' first."""
    rounds = [forests]
    last = forests.filter("kind = 'last'").agg(F.max("part")).first()[0]
    while last is not None:
        last //= FAN
        tag, whole = str(len(rounds)), last == 0
        waiting = rounds[-1].filter("kind in ('piece', 'last')").withColumn("group", F.floor(F.col("part") / FAN).cast("long"))
        merged = waiting.groupBy("group").applyInArrow(_merging(tag, whole), _ROWS)
        rounds.append(stage(merged, "trie-merged", "kind"))
        if whole:
            break
    return rounds


def _references(rounds: list[DataFrame]) -> DataFrame:
    """(ref, conv_id, depth) of every node that was open at the end of some task."""
    known = None
    for rows in reversed(rounds):
        alias = rows.filter("kind = 'alias'")
        closed = alias.filter("key is null").select("ref", F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"))
        if known is not None:
            moved = alias.filter("key is not null").select("ref", "key").join(known.withColumnRenamed("ref", "key"), "key").drop("key")
            closed = known.unionByName(closed).unionByName(moved)
        known = closed
    return stage(known, "trie-references")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of (conv_id, key, sizes), as made by :func:`sequences`."""
    ordered = conversations.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    forests = stage(ordered.select("conv_id", "key", "sizes").mapInArrow(_forests, _ROWS), "trie-forests", "kind")
    rounds = _merge_rounds(forests)
    known = _references(rounds)
    nodes = None
    for rows in rounds:
        found = rows.filter("kind = 'node'").select("conv_id", "depth", "parent", "ref", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "open")
        nodes = found if nodes is None else nodes.unionByName(found)
    told = nodes.filter("ref is null").drop("ref")
    asked = nodes.filter("ref is not null").join(known, "ref").withColumn("parent", F.col("at_conv")).select(told.columns)
    both = told.unionByName(asked)
    ids = forests.filter("kind = 'ends'").select("ref", "part", "seq", F.col("key").alias("ids")).join(known, "ref")
    streamed = (
        ids.select(F.col("at_conv").alias("conv_id"), F.col("at_depth").alias("depth"), "ids", "part", "seq")
        .repartition("conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth", "part", "seq")
        .mapInArrow(_digests, "conv_id long, depth long, digest string")
    )
    spread = both.filter("open").join(streamed, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("digest", "ends")).select(both.columns)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        both.filter("not open")
        .unionByName(spread)
        .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))
    )
