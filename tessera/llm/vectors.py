"""Vector columns: validity, and bounded samples for fitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample(vectors: DataFrame, column: str, limit: int) -> np.ndarray:
    """At most ``limit`` vectors, by hash, the same at every run."""
    rows = vectors.select(F.col(column).alias("v")).orderBy(F.xxhash64("v")).limit(limit).collect()
    return np.array([r["v"] for r in rows], np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; fewer centres where there are fewer rows."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    c = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
