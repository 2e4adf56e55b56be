"""Vectors in Arrow columns: which of them take part, and their values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(v: Column) -> Column:
    """Whether a vector is not null or empty, has only finite components, and isn't zero; never null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is usable."""
    return df.where(is_usable(F.col(column)))


def by_dimension(column: pa.Array):
    """(dimension, rows, matrix of doubles) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows, None] + np.arange(d)]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the greatest component first, so that no square overflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
