"""Vectorised text helpers used inside tasks: bytes, words and window hashes of an Arrow column."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def frugal(run: Callable) -> Callable:
    """``run`` for a task whose worker gives unused memory back to the system at the end: Spark keeps idle workers."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of arbitrary spans of a sequence of 64-bit units, by prefix sums modulo 2**64."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        power, self._inverse = _power(n)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(units * power[:n], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of this length; entry i starts at unit i."""
        n = len(self._sum) - 1
        if n < length:
            return np.empty(0, np.uint64)
        return mix((self._sum[length:] - self._sum[:-length]) * self._inverse[: n - length + 1])


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    column = pc.fill_null(column, pa.scalar(b"", pa.large_binary()) if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes each (one longer text makes a run of its own)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row_offsets) of the maximal runs of bytes other than blank, tab, LF, VT, FF, CR."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[edge - 1] = True
    start = np.flatnonzero(first & ~gap)
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(start, offsets)


def row_of(row_offsets: np.ndarray) -> np.ndarray:
    """Row index of each unit, given the units' offsets by row."""
    return np.repeat(np.arange(len(row_offsets) - 1), np.diff(row_offsets))


def window_ok(row_offsets: np.ndarray, length: int) -> np.ndarray:
    """For every unit but the last length-1: whether a window that starts there stays inside its row."""
    total = int(row_offsets[-1])
    if total < length:
        return np.empty(0, bool)
    left = np.repeat(row_offsets[1:], np.diff(row_offsets)) - np.arange(total)
    return left[: total - length + 1] >= length


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width`` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the units that windows of ``length`` at ``starts`` (each once) cover."""
    delta = np.zeros(total + 1, np.int8)
    delta[starts] += 1
    delta[starts + length] -= 1
    return np.cumsum(delta[:-1], dtype=np.int32) > 0
