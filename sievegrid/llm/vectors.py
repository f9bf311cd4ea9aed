"""Vectors of integers in Arrow batches, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest component: sums of squares of 64 differences, and sums over a table, stay in 64 bits.
LARGEST = 1 << 27


def whole(df: DataFrame, vector: str, size: int | None, scale: int, out: str) -> DataFrame:
    """Rows whose ``vector`` has ``size`` components (any number where None), none null or not finite, as ``out``: floor(scale * x).

    A component beyond LARGEST fails the query, since results would no longer be exact.
    """
    parts = F.col(vector).cast("array<double>")
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.where(fine & (F.size(parts) == size) if size is not None else fine)
    checked = lambda y: F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("component out of range")).cast("int"))
    return kept.withColumn(out, F.transform(parts, lambda x: checked(F.floor(x * F.lit(float(scale))))))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column without nulls as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``: in doubles where they hold every sum, which is faster."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)[None, :]


def squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
