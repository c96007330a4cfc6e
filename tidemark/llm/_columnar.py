"""Helpers that the tasks of several operators share: texts as byte buffers, window hashes, packed arrays.

Everything here runs inside Spark tasks on one Arrow batch; Spark does the partitioning and the shuffles.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BATCH_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: One random odd number per byte value, the same in every process.
BYTE_CODES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
#: The white space that separates words: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give free memory back: a worker serves many tasks, and what its allocators hold on to counts against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(task: Callable) -> Callable:
    """A function of one or two tables that releases memory after each group."""

    def one(table):
        out = task(table)
        release()
        return out

    def two(left, right):
        out = task(left, right)
        release()
        return out

    return one if len(inspect.signature(task).parameters) == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over the whole word."""
    for _ in range(2):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2**64."""
    size = max(BATCH_BYTES + 1, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_ODD, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return next(iter(_POWERS.values()))


class Rolling:
    """Hashes of any run of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        p, self.back = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * p[: len(codes)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of codes[start:end], the same wherever the run stands."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of every run of n codes, by its start."""
        k = len(self.sums) - n
        if k <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[:k])


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks] or [pa.array([], pa.large_binary())])
    return column.cast(pa.large_binary()).fill_null(b"")


def batches(column: pa.ChunkedArray | pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends of the rows) of runs of rows with about limit bytes; one row may be longer."""
    array = binary(column)
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row + 1 : end + 1] - offsets[row]
        row = end


#: For texts compared as plain words: all but ASCII letters, digits and bytes of other characters separate.
PLAIN = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word of the rows that end at ends, and how many words each row has."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = ~space[buf]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    starts_of_rows = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    at = starts_of_rows[starts_of_rows < len(buf)]
    first[at] |= inside[at]
    last = inside[:-1].copy()
    last[:-1] &= ~inside[1:-1]
    stop = ends[ends > 0] - 1
    last[stop] |= inside[stop]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    return start, end, counts


def word_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word."""
    return Rolling(BYTE_CODES[buf]).runs(start, end)


def in_one_row(counts: np.ndarray, n: int) -> np.ndarray:
    """For each item of rows with so many items: do n items from here on stay in the row?"""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + n <= np.repeat(ends, counts)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Is each value in the sorted array?"""
    if not len(among) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def spread(flags: np.ndarray, n: int) -> np.ndarray:
    """Which items lie in one of the n-item windows that start where flags is set."""
    steps = np.zeros(len(flags) + n + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps)[: len(flags)] > 0


def split_by(buckets: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """(bucket, rows) for each bucket that occurs in a sorted array."""
    edge = np.searchsorted(buckets, np.arange(count + 1, dtype=buckets.dtype))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), slice(int(edge[b]), int(edge[b + 1]))


def unpack(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """The packed arrays of a binary column; null is empty."""
    return [np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype=dtype) for chunk in column.chunks for x in chunk]


def joined(arrays: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate([*arrays, np.zeros(0, dtype)]).astype(dtype, copy=False)
