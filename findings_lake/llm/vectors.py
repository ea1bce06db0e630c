"""Numpy views of Arrow vector columns."""

from __future__ import annotations


def matrix(column):
    """``(values, ok)`` of an Arrow list column: float64 rows padded with
    zeros to the longest, and whether a row is whole (not null, no null and no
    non-finite component)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(size.max()) if len(size) else 0))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    good = np.isfinite(values)
    out[row[good], at[good]] = values[good]
    ok = there.copy()
    ok[row[~good]] = False
    return out, ok
