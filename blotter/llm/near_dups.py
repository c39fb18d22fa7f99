"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents of equal sets become one member of the
join. Every set has ``COORDINATES`` minwise tokens. A tree sends each member from its root along
two chosen tokens, to nodes named by path and token; nodes of one member end, small nodes are
compared exhaustively on full sets, larger ones branch again along two other tokens that the path
chooses. ``trees`` independent trees are walked: two sets of similarity s miss each other in all
first-level nodes with probability (1 - s) ** (2 * trees), for 0.85 and three trees 1 in 90,000.

A large node whose members mostly agree with one of them would not shrink by branching. It is cut
into random blocks that are compared exhaustively; two members stand for each class found, and the
next round compares those, until one block is left or they no longer halve. That only joins most
members cheaply: then every two members of the node that are still not joined meet, block by
block, so a large node finds the same components as a small one. Comparisons return a spanning forest of the confirmed links,
never all pairs, so the links grow with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import fresh_name, named, partitions
from blotter.llm.tokens import SPACES, mixed, numbers, pieces, shingles
from blotter.staging import stage

COORDINATES = 32
SHINGLE_WORDS = 5
LEAF = 2048  # members of a node that one task compares, and
LOAD = 1 << 22  # their shingles
MAX_DEPTH = 6
_OFTEN = 24
_SALTS = 16

_SKETCH = "id long, n_shingles long, sid binary, mins array<long>"
_LINKS = "a binary, b binary, sid binary, node long, stands boolean"


def _identity(items: np.ndarray) -> bytes:
    """16 bytes that tell sets apart: two sums over differently mixed items, and the count."""
    with np.errstate(over="ignore"):
        one = mixed(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        two = mixed(items + np.uint64(len(items))).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    factors = numbers(COORDINATES, 5)[:, None] | np.uint64(1)
    shifts = numbers(COORDINATES, 6)[:, None]
    for batch in batches:
        counts, sids, mins = [], [], []
        for piece in pieces(batch.column(1), SPACES):
            for row in shingles(piece, words):
                items = np.unique(row)
                counts.append(len(items))
                if not len(items):
                    sids.append(None)
                    mins.append(None)
                    continue
                least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(items), 8192):
                    spread = items[None, at : at + 8192] * factors
                    spread ^= spread >> np.uint64(29)
                    spread += shifts
                    spread *= np.uint64(0x94D049BB133111EB)
                    np.minimum(least, spread.min(axis=1), out=least)
                sids.append(_identity(items))
                mins.append(least.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(sids, pa.binary()), pa.array(mins, pa.list_(pa.int64())), *batch.columns[2:]],
            names=["id", "n_shingles", "sid", "mins", *batch.schema.names[2:]],
        )


def sketches(docs: DataFrame, id_column: str, text_column: str, words: int, tie: bool = False) -> DataFrame:
    """For each row its id, set size, the set's identity and minwise tokens (null: empty set), and on request a hash of its text (``tie``)."""
    text = named(docs, text_column)
    narrow = docs.select(named(docs, id_column).cast("long").alias("id"), text.alias("text"), *([F.xxhash64(text).alias("tie")] if tie else []))
    return narrow.mapInArrow(partial(_sketch, words=words), _SKETCH + (", tie long" if tie else ""))


def _linked(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets have ``share[1] * intersection >= share[0] * union``.

    Items of many sets are columns of a matrix whose product with itself counts them; the others
    are counted by pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")  # by item, and within it by set
    owner = np.repeat(np.arange(n), sizes)[order]
    begins = np.cumsum(counts) - counts
    common = np.zeros(n * n)
    for c in range(2, min(_OFTEN, n + 1)):
        at = begins[counts == c]
        left, right = np.triu_indices(c, 1)
        for low in range(0, len(at), 1 + (1 << 20) // len(left)):
            held = owner[at[low : low + 1 + (1 << 20) // len(left), None] + np.arange(c)]
            common += np.bincount((held[:, left] * n + held[:, right]).ravel(), minlength=n * n)
    common = common.reshape(n, n)
    common += common.T
    often = counts >= _OFTEN
    column = (np.cumsum(often) - 1)[inverse[order]]
    mask = often[inverse[order]]
    owner, column = owner[mask], column[mask]
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        grid = np.zeros((n, min(4096, int(often.sum()) - low)), dtype=np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        common += grid @ grid.T
    return share[1] * common >= share[0] * (sizes[:, None] + sizes[None, :] - common)


def _forest(linked: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Spanning links of the classes, and the class (its least member) of each."""
    label = np.full(len(linked), -1)
    links = []
    for root in range(len(linked)):
        if label[root] >= 0:
            continue
        label[root], queue = root, [root]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked[at] & (label < 0)).tolist()
            label[found] = root
            links += [(at, to) for to in found]
            queue += found
    return links, label.tolist()


def _compare(batches: Iterator[pa.RecordBatch], words: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each group; rows (node, grp, sid, text) come sorted by (node, grp, sid).

    Gives the links (a, b), and for each member whether it stands for its class in a next round.
    """
    key, members = None, {}

    def finish():
        if len(members) < 2:
            return [(None, None, sid, key[0], True) for sid in members]
        sids = sorted(members)
        links, label = _forest(_linked([members[s] for s in sids], share))
        last = {root: i for i, root in enumerate(label)}
        out = [(sids[i], sids[j], None, None, None) for i, j in links]
        return out + [(None, None, sids[i], key[0], i == root or i == last[root]) for i, root in enumerate(label)]

    def packed(rows):
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "sid", "node", "stands"])

    for batch in batches:
        rows: list = []
        nodes, groups, sids = (batch.column(i).to_pylist() for i in range(3))
        for piece in pieces(batch.column(3), SPACES):
            for i, row in enumerate(shingles(piece, words), piece.first):
                if (nodes[i], groups[i]) != key:
                    if key is not None:
                        rows += finish()
                    key, members = (nodes[i], groups[i]), {}
                if sids[i] not in members:
                    items = np.unique(row)
                    if len(items) and _identity(items) == sids[i]:
                        members[sids[i]] = items
        yield packed(rows)
    if key is not None:
        yield packed(finish())


def _branch(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member of the nodes (path, sid) along two tokens that the node's path chooses."""
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    step = [F.xxhash64("path", c, F.element_at("mins", (c + 1).cast("int"))) for c in (one, two)]
    return nodes.join(sets.select("sid", "mins", "n_shingles"), "sid").select(F.explode(F.array(*step)).alias("path"), "sid", "n_shingles")


def _blocks_of(load: str, times: int = 1, of: Column | None = None):
    """How many times a task's share the rows of a group (or those ``of`` it) are, as an aggregate."""
    counted = F.lit(True) if of is None else of
    return F.ceil(times * F.greatest(F.count_if(counted) / LEAF, F.sum(F.when(counted, F.col(load))) / LOAD)).cast("int")


def _counted(members: DataFrame, label: str) -> DataFrame:
    """Members of nodes of two and more, with the node's size in blocks and first member."""
    sizes = members.groupBy("path").agg(F.count("*").alias("n"), _blocks_of("n_shingles").alias("blocks"), F.min("sid").alias("lead")).filter("n > 1")
    return stage(members.join(sizes, "path"), label)


def _uniform(big: DataFrame, sets: DataFrame) -> DataFrame:
    """For each large node whether three in four members agree with its first in 3 of 4 tokens."""
    leads = big.select("path", "lead").distinct().join(sets.select(F.col("sid").alias("lead"), F.col("mins").alias("first")), "lead")
    agree = F.size(F.filter(F.zip_with("mins", "first", lambda x, y: x == y), lambda same: same))
    near = big.join(sets.select("sid", "mins"), "sid").join(leads.drop("lead"), "path").withColumn("near", agree >= 3 * COORDINATES // 4)
    return near.groupBy("path").agg((F.avg(F.col("near").cast("double")) >= 0.75).alias("uniform"))


def candidate_nodes(sets: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """Small nodes as (grp, sid), each set of members once; large nodes as (path, sid, n_shingles)."""
    roots = [F.xxhash64(F.lit(t), F.lit(c), F.element_at("mins", c + 1)) for t in range(trees) for c in (2 * t, 2 * t + 1)]
    members = sets.select(F.explode(F.array(*roots)).alias("path"), "sid", "n_shingles")
    small, large = [], []
    for depth in range(1, MAX_DEPTH + 1):
        counted = _counted(members, "nodes")
        small.append(counted.filter("blocks = 1").select("path", "sid"))
        big = counted.filter("blocks > 1")
        if big.isEmpty():
            break
        if depth == MAX_DEPTH:
            large.append(big.select("path", "sid", "n_shingles"))
            break
        told = stage(_uniform(big, sets), "uniform")
        large.append(big.join(told.filter("uniform"), "path", "left_semi").select("path", "sid", "n_shingles"))
        members = _branch(big.join(told.filter("not uniform"), "path", "left_semi").select("path", "sid"), sets)
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    alike = leaves.groupBy("path").agg(F.sort_array(F.collect_list("sid")).alias("sids")).select("sids").distinct()
    groups = alike.select(F.xxhash64("sids").alias("grp"), F.explode("sids").alias("sid"))
    rest = sets.select(F.lit(0).cast("long").alias("path"), "sid", "n_shingles").limit(0)
    for more in large:
        rest = rest.unionByName(more)
    return groups, rest


class _Texts:
    """Brings the text of one document of each set to where it is compared."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, sets: DataFrame, words: int, share: tuple[int, int]):
        self.docs = docs.select(named(docs, id_column).cast("long").alias("low"), named(docs, text_column).alias("text")).filter("low is not null")
        self.sets, self.words, self.share = sets.select("sid", "low"), words, share

    def compare(self, members: DataFrame, label: str) -> DataFrame:
        """Links and standing members of the groups (node, grp, sid); no group is larger than some leaves."""
        places = members.groupBy("sid").agg(F.collect_set(F.struct("node", "grp")).alias("places"))
        placed = self.docs.join(places.join(self.sets, "sid"), "low").select(F.explode("places").alias("at"), "sid", "text")
        rows = placed.select("at.node", "at.grp", "sid", "text").repartition(partitions(members.sparkSession), "node", "grp")
        return stage(
            rows.sortWithinPartitions("node", "grp", "sid").mapInArrow(partial(_compare, words=self.words, share=self.share), _LINKS), label
        )


def _blocks(rest: DataFrame, round_: int) -> DataFrame:
    """Members of each node in random blocks of about half a task's share."""
    sizes = rest.groupBy("path").agg(_blocks_of("n_shingles").alias("blocks"))
    several = F.when(F.col("blocks") > 1, 2 * F.col("blocks")).otherwise(1)
    block = F.pmod(F.xxhash64("sid", "path", F.lit(round_)), several)
    return rest.join(sizes, "path").select(F.col("path").alias("node"), block.alias("grp"), "sid")


def _crossed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups in which every two members of a large node meet that are not yet joined by links.

    In each node the members joined with one another in the greatest number (``main``) need not
    meet; the others, in blocks, meet every block of both.
    """
    told = members.join(roots.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    parts = told.groupBy("path", "root").agg(F.count("*").alias("n")).groupBy("path").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
    told = stage(told.join(parts.filter("parts > 1"), "path").select("path", "sid", "n_shingles", (F.col("root") == F.col("main")).alias("main")), "parts")
    # Two blocks together are within a task's share.
    blocks = told.groupBy("path").agg(*[_blocks_of("n_shingles", 3, F.col("main") == main).alias(name) for main, name in ((True, "of_main"), (False, "of_rest"))])
    own = F.when(F.col("main"), F.pmod(F.xxhash64("sid", "path"), F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(F.xxhash64("sid", "path"), F.col("of_rest")))
    first = F.when(F.col("main"), F.col("of_main")).otherwise(0)
    spread = told.join(blocks, "path").withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(first, F.col("of_main") + F.col("of_rest") - 1)))
    pair = F.xxhash64(F.least("own", "other"), F.greatest("own", "other"))
    return spread.filter("own <> other").select(F.col("path").alias("node"), pair.alias("grp"), "sid")


def links(docs: DataFrame, id_column: str, text_column: str, sets: DataFrame, trees: int, words: int, share: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) that join the same sets as all confirmed links."""
    texts = _Texts(docs, id_column, text_column, sets, words, share)
    groups, large = candidate_nodes(sets, trees)
    every = texts.compare(groups.select(F.lit(0).cast("long").alias("node"), "grp", "sid"), "links").select("a", "b")
    members = stage(large, "large")
    rest, left, round_ = members, members.count(), 0
    while left:
        compared = texts.compare(_blocks(rest, round_), "links")
        every = every.unionByName(compared.select("a", "b"))
        standing = compared.filter("stands").select(F.col("node").alias("path"), "sid").distinct()
        spread = rest.join(standing, ["path", "sid"], "left_semi").join(
            rest.groupBy("path").agg(_blocks_of("n_shingles").alias("blocks")).filter("blocks > 1"), "path", "left_semi"
        )
        rest, round_, before = stage(spread, "large"), round_ + 1, left
        left = rest.count()
        if 2 * left > before:
            break
    if round_:
        # The rounds join most members cheaply; those they left apart have not met all others.
        crossed = stage(_crossed(members, components(every.filter("a is not null").distinct())), "crossed")
        if not crossed.isEmpty():
            every = every.unionByName(texts.compare(crossed, "links").select("a", "b"))
    return every.filter("a is not null").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For every end of an edge the least member it is joined with (v, root): least neighbour, then the neighbour's own, until nothing changes."""
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    roots = stage(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("v").alias("u"), "root"), "u").groupBy("v").agg(F.min("root").alias("near"))
        low = roots.join(near, "v").select("v", "root", F.least("root", "near").alias("low"))
        jump = roots.select(F.col("v").alias("low"), F.col("root").alias("top"))
        turned = stage(low.join(jump, "low").select("v", F.least("low", "top").alias("new"), "root"), "roots")
        changed = not turned.filter(F.col("new") != F.col("root")).isEmpty()
        roots = turned.select("v", F.col("new").alias("root"))
        if not changed:
            return roots


def _told(docs: DataFrame, id_column: str, text_column: str, share: tuple[int, int], words: int, trees: int, tie: bool = False) -> DataFrame:
    """The rows of ``near_duplicates`` with the set that stands for the component (``root``), null for the empty set, and with ``tie`` on request."""
    drawn = stage(sketches(docs, id_column, text_column, words, tie), "sketches")
    sets = stage(
        drawn.filter("sid is not null and id is not null").groupBy("sid").agg(F.min("id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("mins").alias("mins")),
        "sets",
    )
    edges = links(docs, id_column, text_column, sets, trees, words, share)
    roots = components(stage(edges, "edges"))
    classes = sets.select("sid", "low").join(roots.select(F.col("v").alias("sid"), "root"), "sid", "left")
    joined = classes.filter("root is not null")
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = joined.join(lowest, "root").select("sid", "component_id", "root").unionByName(
        classes.filter("root is null").select("sid", F.col("low").alias("component_id"), F.col("sid").alias("root"))
    )
    # One set may own a third of the documents: its label is repeated for each salt.
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = drawn.select("id", "n_shingles", "sid", *(["tie"] if tie else []), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt"))
    told = rows.join(salted, ["sid", "salt"], "left")
    component = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return told.withColumn("component_id", component).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    share: tuple[int, int] = (80, 100),
    words: int = SHINGLE_WORDS,
    trees: int = 3,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if ``share[1] * intersection >= share[0] * union`` of their sets;
    a component's id is its smallest document id. A null or empty text, or one without words,
    has the empty set and is linked with nothing. Repeated rows get equal results. Rows without
    an id do not link others: they get the component of a document of the same set, else null
    (and then are kept). Other columns of ``docs`` are neither read nor returned.
    """
    told = _told(docs, id_column, text_column, share, words, trees)
    return told.select(F.col("id").alias(id_column), "n_shingles", "component_id", "kept")


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    share: tuple[int, int] = (80, 100),
    words: int = SHINGLE_WORDS,
    trees: int = 3,
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document of the smallest id.

    Of rows of one group that repeat its id, the one whose text has the smallest hash stays; an
    id that stands at texts of several groups is reduced in each alone. Rows without an id cannot
    be told apart and all stay.
    """
    columns = docs.columns
    told = _told(docs, id_column, text_column, share, words, trees, tie=True).filter("kept and id is not null")
    # Rows with the empty set are linked with nothing, so each text is a group.
    group = F.coalesce("root", F.col("tie").cast("string").cast("binary"))
    kept = told.groupBy("id", group.alias("group")).agg(F.min("tie").alias("__tie")).select(F.col("id").alias("__kept"), "__tie").distinct()
    hash_ = fresh_name(docs, "__hash")
    hashed = docs.withColumn(hash_, F.xxhash64(named(docs, text_column)))
    # Join and window need the same distribution, so texts are exchanged once.
    stay = hashed.join(kept, (named(hashed, id_column) == F.col("__kept")) & (F.col(hash_) == F.col("__tie")), "left_semi")
    order = Window.partitionBy(named(stay, id_column), hash_).orderBy(hash_)
    rank = fresh_name(docs, "__rank")
    ranked = stay.withColumn(rank, F.row_number().over(order))
    first = ranked.filter(F.col(rank) == 1).select(*[named(ranked, c) for c in columns])
    return first.unionByName(docs.filter(named(docs, id_column).isNull()))
