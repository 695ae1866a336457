"""Texts of an Arrow batch as flat byte arrays, for numpy work inside tasks."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer word or text is taken whole where it must be.
WINDOW = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of them; the most asked for so far are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(1 << max(20, int(n).bit_length()), base, dtype=np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            made.append(p)
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and would keep their largest batch."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(len(shift)) + shift


def slices(texts: pa.Array, window: int = WINDOW):
    """(first row, data, offsets) of runs of rows of about ``window`` bytes; null is empty."""
    yield from _slices(texts, window)
    give_back()


def _slices(texts: pa.Array, window: int):
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + window, side="right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[i] the polynomial hash of data[:i]."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], alike wherever the same bytes stand."""
    inverse = powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * inverse[start] + np.uint64(0x51ED2701) * (end - start).astype(np.uint64))


def _windows(data: np.ndarray, offsets: np.ndarray):
    at = 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data):
            ahead = np.flatnonzero(_SPACE[data[end : end + 4096]])
            row = offsets[min(np.searchsorted(offsets, end), len(offsets) - 1)]
            stop = end + int(ahead[0]) if len(ahead) else end + 4096
            if row <= stop or len(ahead):
                end = min(int(row) if row >= end else stop, stop)
                break
            end = min(stop, len(data))
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of the words of a slice; A-Z count as a-z if ``lower``."""
    parts = []
    for a, b in _windows(data, offsets):
        d = _LOWER[data[a:b]] if lower else data[a:b]
        gap = _SPACE[d]
        first = np.zeros(len(d) + 1, dtype=bool)
        inside = offsets[(offsets >= a) & (offsets <= b)] - a
        first[inside] = True
        word = ~gap
        begins = word.copy()
        begins[1:] &= gap[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= gap[1:] | first[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        parts.append((start + a, end + a, span_hashes(prefix_hashes(d), start, end)))
    start, end, h = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.int64, np.int64, np.uint64), strict=True))
    return np.searchsorted(offsets, start, side="right") - 1, start, end, h


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice as one binary array, in order, and how many of them each row has."""
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = word[rows]
    packed, cuts = data[word], np.flatnonzero(begins[word])
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    ends = np.append(cuts, len(packed)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(packed)]), counts
