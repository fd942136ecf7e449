"""Vector columns as numpy blocks, shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, zero: bool) -> DataFrame:
    """``vec_id`` and ``vec`` (array of doubles) of rows that take part.

    Left out: null ids, null vectors, vectors with a null or non-finite component and, unless ``zero``, vectors without a
    component other than zero.
    """
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
            .where(F.col("vec_id").isNotNull() & vec.isNotNull() & ~bad))
    return rows if zero else rows.where(F.exists(vec, lambda x: x != 0))


def widest(rows: DataFrame) -> int:
    """The largest number of components; shorter vectors count as padded with zeros."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros to ``width``."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return np.array(values, np.float64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores of each query, ties to the smaller id, by query and rank."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return order[rank < k]
