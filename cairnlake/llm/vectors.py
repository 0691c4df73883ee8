"""What the operators on vectors (11 and 12) share: rows that take part, and exact integer components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that 64-bit sums of squares of a part's differences can't overflow; greater ones are Python integers.
PLAIN = 1 << 28


def is_whole(vector: Column | str) -> Column:
    """Whether a vector is there and each component is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def kept_vectors(vectors: DataFrame, *columns: str) -> DataFrame:
    """The named columns of rows whose ``embedding`` is whole, not empty, and as long as that of the row of the least vec_id."""
    rows = vectors.select(*columns).where(is_whole("embedding") & (F.size("embedding") > 0))
    first = rows.select(F.size("embedding").alias("n"), "vec_id").orderBy(F.asc_nulls_last("vec_id"), "n").first()
    return rows.where(F.size("embedding") == (first.n if first else 0))


def integers(column: pa.Array, factor: int) -> np.ndarray:
    """floor(factor * x) of each component x, a row for each vector: 64-bit integers, or Python's where those are too small."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() * factor >= PLAIN:
        flat = np.array([int(x) * factor if abs(x) >= 2**53 else math.floor(x * factor) for x in flat.tolist()] + [0], object)[:-1]
    else:
        flat = np.floor(flat * factor).astype(np.int64)
    return flat.reshape(len(column), -1)


def narrowed(x: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones if all are small enough."""
    return x.astype(np.int64) if all(abs(v) < PLAIN for v in x.ravel().tolist()) else x


def int64(x: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones; what does not fit is an error."""
    return x if x.dtype == np.int64 else np.array(x.tolist(), np.int64)
