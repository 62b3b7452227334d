"""Arrow batches to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .errors import DimensionMismatch, InvalidVector


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """The rows of a column of arrays as a matrix. Nulls and other dimensions are errors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.flatten().null_count:
        raise InvalidVector("a vector is null or has null components")
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != dim).any():
        raise DimensionMismatch(dim, int(lengths[lengths != dim][0]))
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), dim)
