"""Exact search for the highest inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. In the order of that key the
vectors are cut into segments, of one pivot each, and a segment into annuli: runs of up to
``ANNULUS`` vectors between two distances. For a query q at distance e from the pivot p, a vector x
of an annulus at distances lo to hi and of norm up to m cannot score above

* q.p + |q| hi, as x - p is no longer than hi;
* (|q|**2 + m**2 - max(0, e - hi, lo - e)**2) / 2, by the triangle inequality for |q - x|;
* |q| m.

The queries of a segment first search the segment itself, which gives each the least score that is
of use. Then each query goes to those other segments alone whose bound reaches that score; there
the annuli are expanded from the highest bound down, until none reaches what the query has by then.
Nothing is approximate: bounds are rounded up, scores are sums of whole numbers.

``PIVOTS`` pivots are chosen among a bounded sample of ``SAMPLE`` vectors, each as far as possible from
those before; they affect the work, not the result. Every vector is indexed.

Components are floor(64 x). Vectors that are null or hold a null or a component that is not finite
take no part, nor do rows without an id; of vectors of different lengths the shorter lacks
components, which count as 0. A row is left out of its own result only: rows with its id and rows with its
vector are found. Equal scores stand in the order of ids, then rows. Repeated query rows have a
result each. Scores beyond 64 bits are the nearest number of 64 bits, and equal where those are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import named
from blotter.operators.positions import with_position
from blotter.staging import stage

PIVOTS = 32
SAMPLE = 2048
ANNULUS = 256
SCALE = 64
LEAST_SEGMENT, LARGEST_SEGMENT, SEGMENTS = 2048, 32768, 1024  # vectors of a segment, and how many segments at first
PANEL = 128  # queries that travel in one row
TURN = 64  # panels that one copy of a segment answers
_EXACT = 2.0**52  # sums of products below this are exact in doubles, in any order
_LOW, _HIGH = -(2**63), 2**63 - 1

_KEYED = "vec_id long, asks boolean, pivot int, distance double, vector binary"
_CELLS = (
    "segment long, pivot int, low double, high double, norm double, ids binary, places binary, distances binary, vectors binary, floors binary, "
    "query_id long, query_place long, vec_id long, place long, score long, kind string"
)
_ROUTED = "segment long, number long, ids binary, places binary, vectors binary, floors binary"
_FOUND = "query_id long, query_place long, vec_id long, place long, score long"


# --- vectors ----------------------------------------------------------------------


def whole_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """floor(64 x) of every component, in doubles, which hold it exactly; None for what takes no part."""
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE)
    at, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    rows = [values[a:b] if v else None for a, b, v in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist())]
    return [r if r is not None and np.isfinite(r).all() else None for r in rows]


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in doubles as bytes: two for each if that is enough."""
    small = not numbers.size or np.abs(numbers).max() < 1 << 15
    return (b"s" + numbers.astype("<i2").tobytes()) if small else (b"d" + numbers.astype("<f8").tobytes())


def unpack(data: bytes, rows: int | None = None) -> np.ndarray:
    """What :func:`pack` was given, as that many rows if told."""
    numbers = np.frombuffer(data, "<i2" if data[:1] == b"s" else "<f8", offset=1).astype(np.float64)
    return numbers if rows is None else numbers.reshape(rows, -1)


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of ``a`` to every row of ``b``, from differences, so without cancellation."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


def norms(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((a**2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exactly, as 64-bit numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if norms(a).max() * norms(b).max() < _EXACT:
        return (a @ b.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), _LOW), _HIGH) for s in b] for r in a], np.int64)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Each as far as possible from those before, then moved a few times to the middle of what is nearest."""
    if not len(sample):
        return np.zeros((1, 1))
    chosen = [sample[0]]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, distances(sample, chosen[-1][None, :])[:, 0])
    pivots = np.stack(chosen)
    for _ in range(4):
        owner = distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[owner == i].mean(axis=0) if (owner == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


# --- bounds and search ------------------------------------------------------------


def bounds(queries: np.ndarray, pivots: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """No score of a query with a vector of pivot ``at``, distance ``low`` to ``high`` and norm up to ``norm`` is above this."""
    width = max(queries.shape[1], pivots.shape[1])
    queries, pivots = _widened(queries, width), _widened(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        size = norms(queries)[:, None]
        to_pivot = distances(queries, pivots)[:, at]
        gap = np.maximum(np.maximum(to_pivot - high, low - to_pivot), 0.0)
        above = np.minimum((queries @ pivots.T)[:, at] + size * high, np.minimum((size**2 + norm**2 - gap**2) / 2, size * norm))
        # Far more than what rounding takes away.
        above = above + 1e-9 * (size * (norms(pivots)[at] + high + norm) + size**2 + norm**2) + 1e-6
    return np.where(np.isnan(above), np.inf, above)


@dataclass
class Segment:
    """Vectors of one pivot in the order of their distances to it, and their annuli."""

    pivot: int
    ids: np.ndarray
    places: np.ndarray
    distance: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.norm = norms(self.vectors)
        self.starts = np.arange(0, len(self.ids), ANNULUS)
        self.low = self.distance[self.starts]
        self.high = self.distance[np.minimum(self.starts + ANNULUS, len(self.ids)) - 1]
        self.most = np.maximum.reduceat(self.norm, self.starts)

    def search(self, queries: np.ndarray, places: np.ndarray, floors: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query its up to ``k`` best (score, id, place) that are not below its floor; floors are raised."""
        best = [(np.zeros(0, np.int64),) * 3 for _ in queries]
        above = bounds(queries, pivots, np.full(len(self.starts), self.pivot), self.low, self.high, self.most)
        order = np.argsort(-above.max(axis=0), kind="stable") if len(queries) else []
        for a in order:
            if above[:, a].max() < floors.min():
                break
            asking = np.flatnonzero(above[:, a] >= floors)
            if not len(asking):
                continue
            within = slice(self.starts[a], self.starts[a] + ANNULUS)
            scores = products(queries[asking], self.vectors[within])
            ids, there = self.ids[within], self.places[within]
            for row, q in enumerate(asking):
                good = np.flatnonzero((scores[row] >= floors[q]) & (there != places[q]))
                if not len(good):
                    continue
                found = [np.concatenate(pair) for pair in zip(best[q], (scores[row, good], ids[good], there[good]))]
                top = np.lexsort((found[2], found[1], ~found[0]))[:k]
                best[q] = tuple(x[top] for x in found)
                if len(top) == k:
                    floors[q] = max(floors[q], best[q][0][-1])
        return best


# --- tasks ------------------------------------------------------------------------


def _keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, asks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(i, a, v) for i, a, v in zip(ids, asks, whole_vectors(batch.column(2))) if v is not None and i is not None]
        out = ([], [], [], [], [])
        for low in range(0, len(rows), 1024):
            some = rows[low : low + 1024]
            far = distances(matrix([v for *_, v in some]), pivots)
            nearest = far.argmin(axis=1)
            for column, values in zip(out, ([r[0] for r in some], [bool(r[1]) for r in some], nearest.tolist(), far[np.arange(len(some)), nearest].tolist(), [pack(r[2]) for r in some])):
                column.extend(values)
        types = (pa.int64(), pa.bool_(), pa.int32(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["vec_id", "asks", "pivot", "distance", "vector"])


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def _batch(spec: str, rows: list[dict]) -> pa.RecordBatch:
    columns = [field.split() for field in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in columns], names=[n for n, _ in columns])


def _numbers(a: np.ndarray) -> bytes:
    return a.astype("<i8").tobytes()


def _answers(ids: np.ndarray, places: np.ndarray, best: list) -> list[dict]:
    return [
        {"query_id": int(q), "query_place": int(p), "vec_id": v, "place": r, "score": s, "kind": "found"}
        for q, p, (scores, vecs, there) in zip(ids, places, best)
        for s, v, r in zip(scores.tolist(), vecs.tolist(), there.tolist())
    ]


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each segment in one row, its queries in panels, and what they find in it."""

    def made(number: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[1])
        ids, places = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        cell = Segment(rows[0][3], ids, places, np.array([r[4] for r in rows]), matrix([unpack(r[5]) for r in rows]))
        yield _batch(_CELLS, [{
            "segment": number, "pivot": cell.pivot, "low": cell.low[0], "high": cell.high[-1], "norm": cell.most.max(), "ids": _numbers(ids), "places": _numbers(places),
            "distances": cell.distance.astype("<f8").tobytes(), "vectors": pack(cell.vectors), "kind": "segment",
        }])
        asks = np.flatnonzero([r[2] for r in rows])
        for low in range(0, len(asks), PANEL):
            some = asks[low : low + PANEL]
            floors = np.full(len(some), _LOW, np.int64)
            best = cell.search(cell.vectors[some], places[some], floors, pivots, k)
            panel = {"segment": number, "ids": _numbers(ids[some]), "places": _numbers(places[some]), "vectors": pack(cell.vectors[some]), "floors": _numbers(floors), "kind": "panel"}
            yield _batch(_CELLS, [panel, *_answers(ids[some], places[some], best)])

    number, rows = None, []
    for batch in batches:
        for segment, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != number and rows:
                yield from made(number, rows)
                rows = []
            number = segment
            rows.append(tuple(row))
    if rows:
        yield from made(number, rows)


def _routed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, catalog) -> Iterator[pa.RecordBatch]:
    """The queries of each panel, to every other segment that may hold something better."""
    segment, pivot, low, high, norm = catalog.value
    for batch in batches:
        for own, ids, places, vectors, floors in zip(*(c.to_pylist() for c in batch.columns)):
            ids, places, floors = (np.frombuffer(x, "<i8") for x in (ids, places, floors))
            vectors = unpack(vectors, len(ids))
            for begin in range(0, len(segment), 1024):
                some = slice(begin, begin + 1024)
                asked = bounds(vectors, pivots, pivot[some], low[some], high[some], norm[some]) >= floors[:, None]
                rows = []
                for j in np.flatnonzero(asked.any(axis=0)):
                    if segment[some][j] != own:
                        q = np.flatnonzero(asked[:, j])
                        rows.append({"segment": int(segment[some][j]), "number": int(places[q[0]]), "ids": _numbers(ids[q]), "places": _numbers(places[q]), "vectors": pack(vectors[q]), "floors": _numbers(floors[q])})
                yield _batch(_ROUTED, rows)


def _searched(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Segments, each followed by the panels sent to it."""
    cell = None
    for batch in batches:
        for pivot, away, ids, places, vectors, floors in zip(*(batch.column(n).to_pylist() for n in ("pivot", "distances", "ids", "places", "vectors", "floors"))):
            ids, places = np.frombuffer(ids, "<i8"), np.frombuffer(places, "<i8")
            vectors = unpack(vectors, len(ids))
            if floors is None:
                cell = Segment(pivot, ids, places, np.frombuffer(away, "<f8"), vectors)
                continue
            best = cell.search(vectors, places, np.frombuffer(floors, "<i8").copy(), pivots, k)
            yield _batch(_FOUND, _answers(ids, places, best))


# --- the operator -----------------------------------------------------------------


def _sampled(vectors: DataFrame) -> np.ndarray:
    """At most ``SAMPLE`` vectors, by the hash of their ids."""
    some = vectors.filter("embedding is not null and vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    rows = [r for r in whole_vectors(some.select("embedding").toArrow().column(0).combine_chunks()) if r is not None and len(r)]
    sample = matrix(rows)
    with np.errstate(over="ignore"):
        return sample[np.isfinite(norms(sample))] if len(sample) else sample


def top_k(table: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row of (vec_id, embedding) where ``asks`` holds."""
    spark = table.sparkSession
    vectors = table.select(named(table, "vec_id").cast("long").alias("vec_id"), asks.alias("asks"), named(table, "embedding").alias("embedding"))
    pivots = choose_pivots(_sampled(vectors))
    keyed = vectors.mapInArrow(partial(_keyed, pivots=pivots), _KEYED)
    order = [F.col(c) for c in ("pivot", "distance", "vec_id", "vector")]
    placed = stage(with_position(keyed, order, "place", "top-k-order"), "top-k-places")
    size = max(LEAST_SEGMENT, min(LARGEST_SEGMENT, -(-placed.count() // SEGMENTS)))
    segment = F.floor(F.col("place") / size).cast("long") * len(pivots) + F.col("pivot")
    cells = stage(
        placed.select(segment.alias("segment"), "vec_id", "place", "asks", "pivot", "distance", "vector")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(partial(_cells, pivots=pivots, k=k), _CELLS),
        "top-k-cells",
        "kind",
    )
    segments = cells.filter("kind = 'segment'")
    told = segments.select("segment", "pivot", "low", "high", "norm").toArrow()  # a row for each segment, of 36 bytes
    catalog = spark.sparkContext.broadcast(tuple(told.column(n).to_numpy() for n in told.column_names))
    panels = cells.filter("kind = 'panel'").select("segment", "ids", "places", "vectors", "floors")
    routed = stage(panels.mapInArrow(partial(_routed, pivots=pivots, catalog=catalog), _ROUTED), "top-k-panels")
    # A segment that many panels are sent to is copied, so that a copy answers about TURN of them.
    copies = routed.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / TURN).cast("int").alias("copies"))
    asked = routed.join(copies, "segment").withColumn("copy", F.pmod(F.xxhash64("number"), "copies").cast("int"))
    asked = asked.select("segment", "copy", F.lit(None).cast("int").alias("pivot"), F.lit(None).cast("binary").alias("distances"), "ids", "places", "vectors", "floors")
    held = segments.join(copies, "segment").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    held = held.select("segment", "copy", "pivot", "distances", "ids", "places", "vectors", "floors")
    searched = (
        held.unionByName(asked)
        .repartition("segment", "copy")
        .sortWithinPartitions("segment", "copy", F.col("floors").isNotNull())
        .mapInArrow(partial(_searched, pivots=pivots, k=k), _FOUND)
    )
    names = [field.split()[0] for field in _FOUND.split(", ")]
    found = cells.filter("kind = 'found'").select(names).unionByName(searched)
    best = Window.partitionBy("query_place").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
