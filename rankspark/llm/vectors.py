"""Shared vector helpers: reading Arrow lists as matrices and telling usable vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(v: F.Column) -> F.Column:
    """Not null, not empty, every component there and finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """float64 rows of a list column whose lists all have d numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def sample(rows: DataFrame, key: str, v: str, n: int, d: int) -> np.ndarray:
    """At most n vectors, those of the smallest hash of their id and value: the documented bound of a fit."""
    picked = rows.orderBy(F.xxhash64(F.col(key).cast("string"), v), key).select(v).limit(n).toArrow()
    return matrix(picked.column(0), d)
