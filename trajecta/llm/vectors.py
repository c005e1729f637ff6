"""What the operators on vectors share: which vectors take part, and their packing for workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(name: str = "embedding") -> Column:
    """True for a vector that is there and whose components are all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(name, finite), F.lit(False))


def longest(df: DataFrame, name: str = "embedding") -> int:
    """The largest number of components, 1 at least; shorter vectors count as filled up with zeros."""
    return max(1, df.agg(F.max(F.size(name))).first()[0] or 0)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column as one matrix, filled up with zeros."""
    out = np.zeros((len(column), width), kind)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.astype(kind).reshape(-1, width)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
