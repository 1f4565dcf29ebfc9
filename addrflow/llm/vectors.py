"""Vector columns inside tasks: an Arrow list column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values) of a list column: the indices of the rows whose vector is there and wholly finite, their
    lengths, and their entries as doubles, filled up with zeros to ``width`` (or to the longest of them)."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(column.is_valid())
    good[row[~np.isfinite(flat)]] = False
    keep, rows = good[row], np.flatnonzero(good)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), int(lengths[rows].max(initial=0)) if width is None else width))
    out[row[keep], at[keep]] = flat[keep]
    return rows, lengths[rows], out[rows]
