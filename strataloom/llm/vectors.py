"""Shared checks of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty, have only finite components, and are not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centroids of each row, nearest first."""
    far = (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)
    n = min(n, len(centroids))
    near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(n), (len(x), 1))
    return np.take_along_axis(near, np.take_along_axis(far, near, axis=1).argsort(axis=1, kind="stable"), axis=1)


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """Centroids of the rows; empty cells start again from a row."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds if k > 1 else 1):
        of = nearest_centroids(x, centroids, 1)[:, 0]
        counts = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), len(centroids))])
    return centroids
