"""Embedding vectors as whole numbers in Arrow batches, shared by the operators that compress and whiten them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import col

SIGN = np.uint32(1 << 31)


def sound(vector):
    """Whether a vector is there and all its components are there and finite."""
    limit = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit)), F.lit(False))


def longest(vectors: DataFrame, vector: str) -> int:
    """Components of the longest vector; 0 without rows."""
    return vectors.agg(F.max(F.size(col(vector)))).first()[0] or 0


def whole(column: pa.Array, width: int, scale: float, limit: int) -> np.ndarray:
    """floor(scale * x) of sound vectors, a row each; short ones are filled up with zeros, numbers beyond ``limit`` count as it."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values, "<f8")[offsets[0]:offsets[-1]]
    numbers = np.clip(np.floor(values * scale), -limit, limit).astype("<i8")
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return numbers.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), "<i8")
    out[np.arange(width) < lengths[:, None]] = numbers
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of 32-bit whole numbers as binary values whose byte order is the order of the rows."""
    data = (rows.astype("<i4").view("<u4") ^ SIGN).astype(">u4").tobytes()
    width = 4 * rows.shape[1]
    if not width:
        return pa.array([b""] * len(rows), pa.binary())
    offsets = pa.py_buffer(np.arange(0, len(data) + 1, width, dtype="<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(data)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The rows of ``packed``."""
    data = b"".join(column.to_pylist())
    return (np.frombuffer(data, ">u4").astype("<u4") ^ SIGN).view("<i4").reshape(len(column), width).astype("<i8")
