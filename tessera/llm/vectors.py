"""Vectors of an Arrow column as dense matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def dense(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, float64 matrix) for each width among the rows that are whole.

    Null and empty vectors and those with a null or non-finite component are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    end = np.cumsum(width)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = (width > 0) & (bad[end] == bad[end - width])
    for w in np.unique(width[whole]):
        rows = np.flatnonzero(whole & (width == w))
        yield int(w), rows, flat[(end[rows] - w)[:, None] + np.arange(w)]


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two just above their largest component: exact, and no square overflows. Zero rows stay."""
    most = np.frexp(np.abs(m).max(axis=1, initial=0))[1]
    return np.ldexp(m, -most[:, None])


def packed(m: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    m = np.ascontiguousarray(m)
    step = m.shape[1] * m.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, width: int, dtype: type) -> np.ndarray:
    """What ``packed`` held, as float64."""
    held = b"".join(column.to_pylist())
    return np.frombuffer(held, dtype).reshape(-1, width).astype(np.float64)
