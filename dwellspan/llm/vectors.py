"""Vectors as whole numbers: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = np.iinfo(np.int64).max


def usable(vector: str, size: int | None = None) -> Column:
    """Not null, of ``size`` components where given, and none of them null or non-finite."""
    v = F.col(vector)
    right = F.lit(True) if size is None else F.size(v) == size
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & right & finite, F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double; beyond the range of longs, its end."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """A list column as a matrix of longs; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = np.diff(column.offsets.to_numpy().astype(np.int64))
    width = int(lengths.max(initial=0)) if size is None else size
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def as_long(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as longs; beyond their range, its end."""
    return x if x.dtype == np.int64 else np.array([min(max(int(v), -LONGEST - 1), LONGEST) for v in x.ravel()], np.int64).reshape(x.shape)
