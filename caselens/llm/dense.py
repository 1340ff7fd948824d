"""Dense vectors as integer matrices, and rows of them as short binary values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries beyond this stand at it.
LARGEST = 1 << 28


def width(df: DataFrame, vector: str) -> int:
    """Entries of the longest vector; 0 where there is none."""
    return df.agg(F.max(F.array_size(vector))).first()[0] or 0


def matrix(column: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``wide`` doubles, shorter ones filled up with 0, and which of them hold finite numbers only.

    A null vector is not among these.
    """
    lists = column.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), wide))
    out[owner, at] = flat
    good = ~lists.is_null().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(flat)]] = False
    return out, good


def floors(rows: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of every entry."""
    return np.clip(np.floor(rows * scale), -LARGEST, LARGEST).astype(np.int32)


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values, in 16 bits where all entries of a row fit; equal rows give equal values."""
    small = (np.abs(rows) < 1 << 15).all(axis=1)
    narrow = rows.astype("<i2")
    return pa.array([(narrow[i] if s else rows[i]).tobytes() for i, s in enumerate(small.tolist())], pa.binary())


def unpack(column: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    """The rows behind ``pack``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), wide), np.int32)
    for kind in ("<i2", "<i4"):
        own = np.flatnonzero(size == wide * np.dtype(kind).itemsize)
        if len(own):
            raw = b"".join(v.as_buffer() for v in column.take(pa.array(own)))
            out[own] = np.frombuffer(raw, kind).reshape(len(own), wide)
    return out
