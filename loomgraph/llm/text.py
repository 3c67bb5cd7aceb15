"""Words of whole texts as 64-bit hashes, found over Arrow buffers in bounded memory without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at at once; a longer text is cut at white space.
SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the result depends on every bit of x."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD1342543DE82EF95
_TABLE = mix(np.arange(256))
_TABLE_LOWER = _TABLE[LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of some texts in order: hash, start and end in `data`; text i has the words first[i] to first[i+1]."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data, start, end, hash_, first):
        self.data, self.start, self.end, self.hash, self.first = data, start, end, hash_, first


def _segment(data: np.ndarray, inner: np.ndarray, keep_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """inner: places at which another text begins, so that no word runs over them."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=word[1:-1])
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[1:-1][inner]
    last[inner - 1] = word[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        values = (_TABLE if keep_case else _TABLE_LOWER)[data]
        values *= up[: len(data)]
        np.cumsum(values, out=sums[1:])
        h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return start, end, mix(h)


def hash_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short spans, as _segment gives them for words."""
    up, sums = _powers(1)[0], np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int((end - start).max()) if len(start) else 0):
            own = start + k < end
            sums[own] += _TABLE_LOWER[data[start[own] + k]] * up[k]
        return mix(sums + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words_of(data: np.ndarray, bounds: np.ndarray, keep_case: bool = False) -> Words:
    """data: bytes of texts side by side; bounds: where each begins, and the end.  No word spans two texts."""
    starts, ends, hashes = [], [], []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SEGMENT, "right")) - 1)
        lo, stop = int(bounds[i]), int(bounds[j])
        while lo < stop:
            hi = stop
            if hi - lo > SEGMENT:  # a long text: cut where white space stands, or else (a huge word) at its end
                cut = np.flatnonzero(SPACE[data[lo : lo + SEGMENT]])
                if len(cut):
                    hi = lo + int(cut[-1]) + 1
                else:
                    rest = np.flatnonzero(SPACE[data[lo + SEGMENT : stop]])
                    hi = lo + SEGMENT + int(rest[0]) + 1 if len(rest) else stop
            s, e, h = _segment(data[lo:hi], bounds[i + 1 : j] - lo, keep_case)
            starts.append(s + lo), ends.append(e + lo), hashes.append(h)
            lo = hi
        i = j
    cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    start, end, h = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
    return Words(data, start, end, h, np.searchsorted(start, bounds))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), bounds


def give_back() -> None:
    """Memory that a task has freed goes back to the system: workers serve other tasks later, and their executor's share
    is one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `size` bytes of text at most (a longer text comes alone), with their bytes and bounds."""
    try:
        yield from _slices(batches, text, size)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, bounds = buffers(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
            j = min(j, n)
            lo, hi = int(bounds[i]), int(bounds[j])
            yield batch.slice(i, j - i), data[lo:hi], bounds[i : j + 1] - lo
            i = j


def one_hash(word: bytes, keep_case: bool = False) -> int:
    """The hash of one word, as words_of gives it."""
    data = np.frombuffer(word, np.uint8)
    return int(words_of(data, np.array([0, len(data)]), keep_case).hash[0])
