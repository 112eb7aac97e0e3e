"""Vector columns as matrices of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows of ``df`` whose ``vector`` is not null, holds neither null nor non-finite entries, and has the
    table's dimension: the most frequent length of such vectors, the larger of two as frequent ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fine = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    most = fine.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size(vector) == (most["d"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def integers(column: pa.Array, scale: int, most: int = 1 << 62) -> np.ndarray:
    """floor(scale * entry) of a list column, at most ``most`` either way."""
    return np.clip(np.floor(matrix(column) * scale), -float(most), float(most)).astype(np.int64)
