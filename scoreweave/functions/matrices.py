"""Small numpy helpers used inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal-length rows as a 2-D float64 array."""
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % rows:
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1)


def list_column(matrix: np.ndarray) -> pa.Array:
    """The inverse: one Arrow list per matrix row."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def stack(series) -> np.ndarray:
    """A pandas column of arrays as a matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))
