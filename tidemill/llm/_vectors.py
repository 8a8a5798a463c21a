"""Vectors in Arrow list columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors that occurs: the numbers of its rows, ascending, and their vectors as doubles. Rows that are
    null, have no entries or hold null or non-finite entries are left out."""
    if not len(column):
        return
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values.reshape(-1, d) if len(rows) * d == len(values) else values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        yield rows[good], x[good]


def stacked(column: pa.Array) -> np.ndarray:
    """Binary rows of equal length as a matrix of bytes."""
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + rows + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(rows, -1)


def binary_rows(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    if x.nbytes < 2**31:
        offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
    return pa.array([row.tobytes() for row in x], pa.binary())
