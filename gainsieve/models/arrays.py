"""Columns of Arrow batches as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; what a shorter vector or a null lacks is NaN."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    dense = np.full((len(lengths), width), np.nan)
    row = np.repeat(np.arange(len(lengths)), lengths)
    dense[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return dense
