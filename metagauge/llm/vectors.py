"""Columns of vectors: which of them count, and as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(name: str = "embedding") -> Column:
    """True for a vector that is not null and holds neither nulls nor anything but finite numbers."""
    out_of_range = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(~F.exists(name, lambda c: out_of_range(c.cast("double"))), F.lit(False))


def widest(df: DataFrame, name: str) -> int:
    """The greatest length of the vectors."""
    return df.agg(F.max(F.size(name))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a shorter one has zeros at its end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # without chunks
        return np.zeros((0, width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), values.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[row, np.arange(len(values)) - first[row]] = values
    return out


def rows_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))
