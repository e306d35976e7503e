"""Arrow list columns as NumPy matrices, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long number lists as a double-precision (rows, entries) matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) and len(values) % len(lists):
        raise ValueError("all vectors must have the same length")
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths. Squares are summed entry by entry, as `functions.vectors.length` does."""
    squares = np.zeros(len(matrix))
    for entries in matrix.T:
        squares += entries * entries
    return matrix / np.sqrt(squares)[:, None]
