"""Whole texts as one byte buffer, cut into words and hashed with numpy: no Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: From so many MB on an array is mapped by itself, and so many free MB at the heap's end go back to the system. ROOMY spares
#: work on many arrays of 8 MB the mapping of each.
CLOSE, ROOMY = (4, 16), (16, 64)
_libc = None


def _limits(mapped: int, free: int) -> None:
    if _libc is not None:
        _libc.mallopt(-3, mapped << 20)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, free << 20)  # M_TRIM_THRESHOLD


try:  # working arrays go back to the system when they are freed: Python workers live on between stages
    _libc = ctypes.CDLL("libc.so.6")
    _limits(*CLOSE)
except (OSError, AttributeError):  # another C library: only more memory is held
    _libc = None


def released() -> None:
    """Gives the system what Arrow's pool and the C library hold free, and the table of powers: a worker that waits for its
    next task keeps them else."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(work: Callable, limits: tuple[int, int] = CLOSE) -> Callable:
    """work on record batches that ends with released()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _limits(*limits)
        try:
            yield from work(batches)
        finally:
            _limits(*CLOSE)
            released()

    return run


def lean_group(work: Callable) -> Callable:
    """work on one group that ends with released()."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return work(key, t)
        finally:
            released()

    return run


def lean_cogroup(work: Callable) -> Callable:
    """work on two tables of a group that ends with released()."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return work(key, a, b)
        finally:
            released()

    return run


U64 = np.uint64
#: Texts are worked on in runs of at most so many bytes (one longer text makes a run of its own).
RUN_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_PI = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: each input bit reaches each output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = n | (1 << 16) - 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, p, U64)])) for p in (_P, _PI)]
    return _powers[0][:n], _powers[1][:n]


class Run:
    """Some texts: data (UTF-8 bytes), offsets (n + 1 places in data), lo (the first text's row in its record batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int = 0):
        self.data, self.offsets, self.lo = data, offsets.astype(np.int64), lo
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def lowered(self) -> Run:
        return Run(LOWER[self.data], self.offsets, self.lo)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def spans(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are not breaks; texts' borders cut them too."""
        d, n = ~breaks, len(breaks)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = np.empty(n, bool), np.empty(n, bool)
        first[0] = last[-1] = True
        first[1:], last[:-1] = breaks[:-1], breaks[1:]
        a, b = self.offsets[:-1], self.offsets[1:]
        first[a[a < n]] = True
        last[b[b > 0] - 1] = True
        return np.flatnonzero(d & first), np.flatnonzero(d & last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the words' places by text: words of text i are at bounds[i]:bounds[i + 1]."""
        starts, ends = self.spans(SPACE[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        n = len(self.data)
        up, down = _pow(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, U64)
            np.cumsum(_CODE[self.data] * up[:n], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all byte ranges of length k, one at each start."""
        n = len(self.data)
        if self._sums is None:
            self.hashes(np.zeros(0, np.int64), np.zeros(0, np.int64))
        h = self._sums[k:] - self._sums[: n - k + 1]
        h *= _pow(n + 1)[1][: n - k + 1]
        h ^= h >> U64(32)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(29)
        return h


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words, and the place of each window's first word; windows never cross texts."""
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        out = mix(out * U64(3) + h[i : len(h) - k + 1 + i])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])
    return out[at], at


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """The column's texts in runs of at most limit bytes, or one text."""
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Run(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi
