"""Arrow columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column whose vector has entries, all of them finite numbers, and these vectors as doubles.

    Null and empty vectors and those that hold a null or non-finite entry are left out.
    Vectors of different lengths are an error, since no product of them is defined.
    """
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    entries = column.values[offsets[0] : offsets[-1]] if len(offsets) else column.values
    offsets = offsets - offsets[0]
    values = entries.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sizes = np.diff(offsets)
    good = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.zeros((0, 0))
    width = sizes[rows[0]]
    if (sizes[rows] != width).any():
        raise ValueError("vectors of different lengths")
    return rows, values[offsets[rows][:, None] + np.arange(width)]


def chunks_of(batches, size: int):
    """Record batches cut into slices of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
