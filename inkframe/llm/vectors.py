"""What the operators on vectors share: which vectors count, and packing them for the way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero, and all its components are finite numbers."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows with a usable vector."""
    return df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, first by their largest component so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def common_width(vectors) -> int:
    """The most frequent length of the given vectors, the smaller of equally frequent ones."""
    sizes, counts = np.unique([len(v) for v in vectors], return_counts=True)
    return int(sizes[counts.argmax()])
