"""Operator 2: exact top-k inner products by a pivot-distance index.

Inner products become distances: every vector x gets the component sqrt(M^2 - |x|^2), with M the largest norm, queries get
0 there, and the nearest vector is then the one with the largest product. Each vector is keyed by its nearest pivot and its
distance to it; a cell's distances are cut into annuli, sorted by distance, and packed into blocks. For a query at distance
d of a pivot the triangle inequality bounds every product in the annulus [low, high]; a query expands its annuli from the
best bound down and stops below its k-th score so far.

* Pivots and cuts come from a bounded sample of ``SAMPLE`` rows; there are ``PIVOTS * RINGS`` annuli at any size, so the
  directory with their exact bounds may be broadcast. All rows are indexed.
* Blocks have at most ``BLOCK`` rows, dealt by range of (pivot, ring, distance, id): a hot cell or a vector that a third of
  all rows share is spread over tasks, and joins see block rows, never pairs of vectors.
* Queries are rows of the index: their first k-th score comes from the block in which they lie.

* Arithmetic is exact at any size: doubles while every product stays below 2^53, 64-bit integers below 2^63, whole numbers of any length
  beyond. Blocks hold components as 32-bit integers, or as doubles if the table has a component outside that range.

Defined cases: components are floor(256 x), of any size; a score that is asked for and lies beyond +-(2^63 - 1) is an error; shorter vectors
are padded with zeros; rows that ``usable_vectors`` leaves out take no part; a repeated vec_id counts as several candidates and its copies as one query each
only if their vectors differ; a query's own row is every row with its vec_id; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.vectors import best, matrix, usable_vectors, widest
from linklens.session import stage

SAMPLE, PIVOTS, RINGS, BLOCK, QUERY_CHUNK = 4096, 32, 8, 2048, 256
# Annuli that a query visits before its bound is tightened.
FIRST_RINGS = 8
LONGEST, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
BLOCK_SCHEMA = "pivot int, ring int, low double, high double, n int, ids binary, vecs binary"


def quantised(vecs: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """Whole components, as doubles: exact, because the scale is a power of two."""
    return np.floor(vecs * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of ``a`` and ``b``, whole numbers: 64-bit integers where all fit, else Python's."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(a), whole(b).T)


def as_longs(score: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; ``NONE`` stands for all that are too small, an allowed one that is too large is an error."""
    if score.dtype != object:
        return score
    if (allowed & (score > LONGEST)).any():
        raise OverflowError("a score lies beyond 64 bits")
    return np.clip(score, NONE, LONGEST).astype(np.int64)


class Pivots:
    """Pivots and ring borders in the space with the added component."""

    def __init__(self, sample: np.ndarray, square: float, pivots: int, rings: int):
        self.square = square
        points = self.lift(sample)
        chosen = [0] if len(points) else []
        away = np.linalg.norm(points - points[0], axis=1) if len(points) else np.zeros(0)
        while len(chosen) < min(pivots, len(points)) and away.max() > 0:  # farthest first
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
        self.points = points[chosen]
        nearest, distance = self.nearest(points) if len(points) else (np.zeros(0, int), np.zeros(0))
        steps = np.arange(1, rings) / rings
        self.cuts = [np.quantile(d, steps) if len(d := distance[nearest == p]) else np.zeros(rings - 1)
                     for p in range(len(self.points))]

    def lift(self, vecs: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.square - (vecs.astype(np.float64) ** 2).sum(1))
        return np.hstack([vecs.astype(np.float64), np.sqrt(rest)[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points ** 2).sum(1)[:, None] + (self.points ** 2).sum(1)[None] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(0.0, squares))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = self.distances(points)
        pivot = away.argmin(1)
        return pivot, away[np.arange(len(points)), pivot]

    def bounds(self, queries: np.ndarray, rings: list[tuple[int, int, float, float]]) -> np.ndarray:
        """No product of a query (row) with a vector of an annulus (column) is larger."""
        points = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        away = self.distances(points)[:, [r[0] for r in rings]]
        low, high = (np.array([r[i] for r in rings]) for i in (2, 3))
        least = np.maximum(0.0, np.maximum(low - away, away - high))
        squares = (points ** 2).sum(1)[:, None]
        slack = 1e-6 * (squares + self.square + 1)  # far above the rounding of the distances
        return (squares + self.square - least ** 2) / 2 + slack


def _key(index: Pivots, width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = quantised(matrix(batch.column("vec"), width))
            pivot, away = index.nearest(index.lift(vecs)) if len(vecs) else (np.zeros(0, int), np.zeros(0))
            ring = np.array([np.searchsorted(index.cuts[p], d) for p, d in zip(pivot, away)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(away, pa.float64()),
                 pa.array([v.tobytes() for v in vecs.astype(kind)], pa.binary())], ["vec_id", "pivot", "ring", "away", "vec"])
    return run


def _blocks(block: int):
    """Runs of one annulus as blocks."""
    def close(pivot, ring, rows):
        ids = np.array([r[0] for r in rows], "<i8")
        vecs = b"".join(r[2] for r in rows)
        return [pivot, ring, rows[0][1], rows[-1][1], len(rows), ids.tobytes(), vecs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        names = ["pivot", "ring", "low", "high", "n", "ids", "vecs"]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        emit = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)
        for batch in batches:
            for vec_id, pivot, ring, away, vec in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "pivot", "ring", "away", "vec"))):
                if rows and (now != (pivot, ring) or len(rows) >= block):
                    yield emit(close(*now, rows))
                    rows = []
                now = (pivot, ring)
                rows.append((vec_id, away, vec))
        if rows:
            yield emit(close(*now, rows))
    return run


def _unpack(ids: bytes, vecs: bytes, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(vecs, kind).reshape(len(numbers), width).astype(np.float64)


def _scores(numbers, vecs, own, queries, least, k):
    """The best candidates of each query in one block: positions of queries, ids and scores."""
    other = numbers[None] != own[:, None]
    score = as_longs(products(queries, vecs), other)
    allowed = other & (score >= least[:, None])
    if len(numbers) > 4 * k:  # only what reaches the k-th best of the block
        kept = np.where(allowed, score, NONE)
        allowed &= score >= np.partition(kept, len(numbers) - k, axis=1)[:, len(numbers) - k][:, None]
    at, col = np.nonzero(allowed)
    pick = best(at, numbers[col], score[at, col], k)
    return at[pick], numbers[col[pick]], score[at[pick], col[pick]]


def _first(width: int, every: int, k: int, kind: str):
    """Queries of each block with the k-th score that their own block gives (null: fewer than k)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column("ids").to_pylist(), batch.column("vecs").to_pylist()):
                numbers, vecs = _unpack(ids, packed, width, kind)
                chosen = np.flatnonzero(numbers % every == 0)
                for first in range(0, len(chosen), QUERY_CHUNK):
                    part = chosen[first:first + QUERY_CHUNK]
                    at, _, score = _scores(numbers, vecs, numbers[part], vecs[part], np.full(len(part), NONE), k)
                    kth = np.full(len(part), NONE)
                    counts = np.bincount(at, minlength=len(part))
                    np.minimum.at(low := np.full(len(part), LONGEST), at, score)
                    kth[counts >= k] = low[counts >= k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[part]), pa.array([v.tobytes() for v in vecs[part].astype(kind)], pa.binary()),
                         pa.array(kth)], ["query_id", "query", "least"])
    return run


def _expand(index: Pivots, rings: list[tuple[int, int, float, float]], width: int, kind: str, first: int, last: int | None):
    """The annuli ``first`` to before ``last`` of each query in falling order of their bounds, as chunks of queries an annulus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not rings:
                continue
            own = np.array(batch.column("query_id").to_pylist(), np.int64)
            least = np.array(batch.column("least").to_pylist(), np.int64)
            queries = np.frombuffer(b"".join(batch.column("query").to_pylist()), kind).reshape(len(own), width).astype(np.float64)
            for start in range(0, len(own), QUERY_CHUNK):
                cut = slice(start, start + QUERY_CHUNK)
                bounds = index.bounds(queries[cut], rings)
                wanted = np.zeros(bounds.shape, bool)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                np.put_along_axis(wanted, order, True, axis=1)
                wanted &= (bounds >= least[cut][:, None]) | (least[cut] == NONE)[:, None]  # without k scores nothing is ruled out
                for r in np.flatnonzero(wanted.any(0)):
                    who = np.flatnonzero(wanted[:, r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rings[r][0]], pa.int32()), pa.array([rings[r][1]], pa.int32()),
                         pa.array([own[cut][who].astype("<i8").tobytes()]), pa.array([least[cut][who].astype("<i8").tobytes()]),
                         pa.array([queries[cut][who].astype(kind).tobytes()])], ["pivot", "ring", "own", "least", "queries"])
    return run


def _search(width: int, k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed, own, least, packed_queries in zip(*(batch.column(c).to_pylist() for c in ("ids", "vecs", "own", "least", "queries"))):
                numbers, vecs = _unpack(ids, packed, width, kind)
                who, queries = _unpack(own, packed_queries, width, kind)
                at, found, score = _scores(numbers, vecs, who, queries, np.frombuffer(least, "<i8"), k)
                # the query's vector tells apart rows that share an id
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[at]), pa.array([queries[i].astype(kind).tobytes() for i in at], pa.binary()), pa.array(found), pa.array(score)],
                    ["query_id", "query", "vec_id", "score"])
    return run


FOUND = "query_id long, query binary, vec_id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(table: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer products of each query with the rows of other ids."""
    spark = table.sparkSession
    rows = usable_vectors(table, zero=True)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = widest(rows)
    if not width:  # no vectors, or only vectors without components: every product is 0
        if rows.isEmpty():
            return empty
        width = 1
    # doubles from 2^53 on are whole numbers already, and floor() gives a long
    whole = F.transform("vec", lambda x: F.when(F.abs(x * 256) < 2.0 ** 53, F.floor(x * 256).cast("double")).otherwise(x * 256))
    square, largest = rows.select(whole.alias("q")).select(
        F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x).alias("s"), F.array_max(F.transform("q", F.abs)).alias("m")).agg(F.max("s"), F.max("m")).first()
    if not np.isfinite(square):
        raise OverflowError("a vector's length lies beyond the range of doubles")
    kind = "<i4" if largest < 2.0 ** 31 else "<f8"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).toPandas()["vec"]
    points = quantised(np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in sample]).reshape(-1, width))
    index = Pivots(points, float(square) * (1 + 1e-12), pivots, rings)

    keyed = rows.mapInArrow(_key(index, width, kind), "vec_id long, pivot int, ring int, away double, vec binary")
    order = ["pivot", "ring", "away", "vec_id"]
    blocks = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_blocks(block), BLOCK_SCHEMA), "pivot-blocks")
    directory = [tuple(r) for r in blocks.groupBy("pivot", "ring").agg(F.min("low"), F.max("high")).orderBy("pivot", "ring").collect()]

    queries = stage(blocks.select("ids", "vecs").mapInArrow(_first(width, every, k, kind), "query_id long, query binary, least long")
                    .groupBy("query_id", "query").agg(F.max("least").alias("least")), "pivot-queries")
    chunk = "pivot int, ring int, own binary, least binary, queries binary"

    def visit(asked: DataFrame, first: int, last: int | None) -> DataFrame:
        wanted = asked.mapInArrow(_expand(index, directory, width, kind, first, last), chunk)
        # both sides grow with the table and the chunks' size can't be estimated: never broadcast
        pairs = wanted.hint("merge").join(blocks.select("pivot", "ring", "ids", "vecs"), ["pivot", "ring"])
        return ranked(pairs.select("ids", "vecs", "own", "least", "queries").mapInArrow(_search(width, k, kind), FOUND), k).drop("rank")

    near = stage(visit(queries, 0, FIRST_RINGS), "pivot-near")
    kth = near.groupBy("query_id", "query").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    tightened = (queries.join(kth, ["query_id", "query"], "left")
                 .select("query_id", "query", F.when(F.col("n") >= k, F.greatest("least", "kth")).otherwise(F.col("least")).alias("least")))
    found = ranked(near.unionByName(visit(tightened, FIRST_RINGS, None)), k)
    beyond = F.raise_error(F.lit("a score lies beyond 64 bits")).cast("long")
    return found.select("query_id", "rank", "vec_id", F.when(F.col("score") == int(NONE), beyond).otherwise(F.col("score")).alias("score"))
