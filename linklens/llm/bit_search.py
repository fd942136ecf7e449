"""Operator 6: nearest neighbours by randomly rotated one-bit codes.

Every vector, less the centre, is padded to ``BITS`` components, turned by one seeded random rotation, and kept as the signs
of its components with three scalars: its distance from the centre, its product with the centre, and the product of its
direction with its own code, which corrects the estimate. For a query the product of its rotated residual with the
code, divided by that scalar, estimates the inner product; the error is a random variable of known spread, so each
candidate has a lower and an upper bound. A candidate whose upper bound lies below the k-th lower bound of its block, or below the
k-th score that the query's own block proves, is dropped; the others are ranked by their exact products in double precision.

The centre is the mean of a bounded sample (``SAMPLE`` rows); every row is coded. Blocks hold at most ``BLOCK`` vectors, chunks
at most ``QUERY_CHUNK`` queries; each chunk meets each block once, by an equality join on the block's number, and gives at most
k rows a query: no pair of vectors becomes a row. ``ERROR`` is the half width in standard deviations.

Defined cases: rows that ``usable_vectors`` leaves out (null id, null, zero, non-finite) take no part; shorter vectors are padded with
zeros; a query's own row is every row with its id; copies of a query id with other vectors are queries of their own; equal
scores go by the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.vectors import best, matrix, usable_vectors, widest
from linklens.session import stage

SAMPLE, BLOCK, QUERY_CHUNK = 4096, 8192, 512
# Groups of blocks that chunks of queries are sent to: tasks of the join at most.
MOST_GROUPS = 4096
ERROR = 3.0
SEED = 20_240_607


def code_bits(width: int) -> int:
    """Bits of a code: at least 256, since short codes estimate too loosely, and at least the vector's width."""
    return -(-max(256, width) // 64) * 64


@functools.lru_cache(maxsize=2)
def rotation(bits: int, width: int, seed: int = SEED) -> np.ndarray:
    """The first ``width`` columns of a random orthogonal matrix: a rotation of vectors padded with zeros."""
    basis, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, width)))
    return basis * np.sign(np.diag(upper))


def encode(vecs: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, and per vector: distance from the centre, product with the centre, product with its own code."""
    rest = vecs - centre
    away = np.linalg.norm(rest, axis=1)
    turned = rest @ rotation(bits, vecs.shape[1]).T
    packed = np.packbits(turned > 0, axis=1, bitorder="little")
    own = np.abs(turned).sum(1) / np.sqrt(bits) / np.maximum(away, np.finfo(float).tiny)
    return packed, np.stack([away, vecs @ centre, np.where(away > 0, own, 1.0)], axis=1)


def estimate(queries: np.ndarray, centre: np.ndarray, packed: np.ndarray, scalars: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products (queries by vectors) and the spread of the estimates."""
    rest = queries - centre
    turned = (rest @ rotation(bits, queries.shape[1]).T).astype(np.float32)
    signs = np.unpackbits(packed, axis=1, count=bits, bitorder="little").astype(np.float32)
    signs = (2 * signs - 1) / np.float32(np.sqrt(bits))
    away, middle, own = scalars.T
    inner = (turned @ signs.T).astype(np.float64) / own
    value = inner * away + middle + (queries @ centre)[:, None] - centre @ centre
    spread = np.linalg.norm(rest, axis=1)[:, None] * away * np.sqrt(np.maximum(0.0, 1 - own ** 2)) / own / np.sqrt(bits - 1)
    return value, spread


def inner_products(vecs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one order, so that equal vectors have equal scores wherever they lie."""
    return np.einsum("ij,j->i", vecs, query)


def search_block(numbers, vecs, packed, scalars, centre, own, queries, proven, k, error):
    """The k best candidates of each query among those that the bounds leave."""
    bits = packed.shape[1] * 8
    value, spread = estimate(queries, centre, packed, scalars, bits)
    slack = 1e-5 * (1 + np.abs(value))  # single precision
    low, high = value - error * spread - slack, value + error * spread + slack
    same = numbers[None] == own[:, None]
    low[same] = high[same] = -np.inf
    threshold = proven.copy()
    if len(numbers) >= k:
        threshold = np.maximum(threshold, np.partition(low, len(numbers) - k, axis=1)[:, len(numbers) - k])
    at, found, scores = [], [], []
    for i, query in enumerate(queries):
        chosen = np.flatnonzero((high[i] >= threshold[i]) & ~same[i])
        score = inner_products(vecs[chosen], query)
        pick = best(np.zeros(len(chosen), int), numbers[chosen], score, k)
        at.append(np.full(len(pick), i))
        found.append(numbers[chosen[pick]])
        scores.append(score[pick])
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def _blocks(centre: np.ndarray, width: int, bits: int, size: int):
    names = ["block", "ids", "vecs", "packed", "scalars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, held, ids = TaskContext.get().partitionId(), 0, [], []

        def close(numbers, vecs):
            packed, scalars = encode(vecs, centre, bits)
            row = [(part << 32) + seq, numbers.astype("<i8").tobytes(), vecs.astype("<f8").tobytes(), packed.tobytes(), scalars.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in row[1:])], names)

        for batch in batches:
            ids.append(np.asarray(batch.column("vec_id")))
            held.append(matrix(batch.column("vec"), width))
            while sum(map(len, ids)) >= size:
                numbers, vecs = np.concatenate(ids), np.concatenate(held)
                yield close(numbers[:size], vecs[:size])
                ids, held, seq = [numbers[size:]], [vecs[size:]], seq + 1
        if sum(map(len, ids)):
            yield close(np.concatenate(ids), np.concatenate(held))
    return run


def _chunks(width: int, every: int, k: int):
    """Chunks of the queries of each block, with the k-th score that the block itself proves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column("ids").to_pylist(), batch.column("vecs").to_pylist()):
                numbers = np.frombuffer(ids, "<i8")
                vecs = np.frombuffer(packed, "<f8").reshape(len(numbers), width)
                chosen = np.flatnonzero(numbers % every == 0)
                for first in range(0, len(chosen), QUERY_CHUNK):
                    part = chosen[first:first + QUERY_CHUNK]
                    score = vecs[part] @ vecs.T
                    score[numbers[None] == numbers[part][:, None]] = -np.inf
                    proven = np.partition(score, len(numbers) - k, axis=1)[:, len(numbers) - k] if len(numbers) >= k else np.full(len(part), -np.inf)
                    proven = proven - 1e-9 * (1 + np.abs(np.where(np.isfinite(proven), proven, 0)))
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (
                        numbers[part].tobytes(), vecs[part].tobytes(), proven.astype("<f8").tobytes())], ["own", "queries", "proven"])
    return run


def _search(centre: np.ndarray, width: int, bits: int, k: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, packed, scalars, own, queries, proven in zip(*(batch.column(c).to_pylist() for c in (
                    "ids", "vecs", "packed", "scalars", "own", "queries", "proven"))):
                numbers, who = np.frombuffer(ids, "<i8"), np.frombuffer(own, "<i8")
                asked = np.frombuffer(queries, "<f8").reshape(len(who), width)
                at, found, score = search_block(
                    numbers, np.frombuffer(vecs, "<f8").reshape(len(numbers), width), np.frombuffer(packed, np.uint8).reshape(len(numbers), bits // 8),
                    np.frombuffer(scalars, "<f8").reshape(len(numbers), 3), centre, who, asked, np.frombuffer(proven, "<f8"), k, error)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[at]), pa.array([asked[i].tobytes() for i in at], pa.binary()), pa.array(found, pa.int64()), pa.array(score, pa.float64())],
                    ["query_id", "query", "vec_id", "score"])
    return run


def nearest(table: DataFrame, every: int = 20, k: int = 20, error: float = ERROR, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest inner products found for each query."""
    spark = table.sparkSession
    rows = usable_vectors(table, zero=False)
    width = widest(rows)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bits = code_bits(width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).toPandas()["vec"]
    centre = np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in sample]).mean(0)
    blocks = stage(rows.mapInArrow(_blocks(centre, width, bits, block), "block long, ids binary, vecs binary, packed binary, scalars binary"),
                   "bit-blocks")
    # each chunk meets each block once: blocks are dealt into groups, chunks are sent to every group
    groups = max(1, min(blocks.count(), MOST_GROUPS))
    chunks = (blocks.select("ids", "vecs").mapInArrow(_chunks(width, every, k), "own binary, queries binary, proven binary")
              .withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    pairs = blocks.withColumn("dealt", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(chunks, "dealt")
    found = (pairs.select("ids", "vecs", "packed", "scalars", "own", "queries", "proven")
             .mapInArrow(_search(centre, width, bits, k, error), "query_id long, query binary, vec_id long, score double"))
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
