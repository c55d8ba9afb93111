"""Vectors for the searches: valid rows, query sets, and shards and query blocks that meet in bounded tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(n: int) -> Column:
    """0 to n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))


def finite(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def matrix(vectors, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of dim columns; shorter vectors end in zeros."""
    import pyarrow as pa

    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(np.asarray(vectors.offsets))
    values = np.asarray(vectors.flatten(), dtype=kind)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def dimension(df: DataFrame, vector: str) -> int:
    """The most components that a vector has."""
    return df.agg(F.max(F.size(vector)).alias("d")).first()["d"] or 0


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, summed from the first component to the last, so that equal rows and
    either order of the two sides give the same bits."""
    out = np.zeros(len(x), dtype=x.dtype)
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def best_of_each(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the highest score of each id."""
    order = np.lexsort((-scores, ids))
    first = np.ones(len(order), dtype=bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    return order[first]


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
