"""Vectorised word work on Arrow string buffers: no Python object is made for a word.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All functions take the bytes of many
documents at once and the documents' offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _GOLD = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts) of consecutive parts of about ``size`` bytes; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size)))
        yield start, texts.slice(start, stop - start)
        start = stop


def find_words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one entry more at the end)."""
    word = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = word.copy(), word.copy()
    if len(raw):
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _GOLD + np.uint64(seed))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    active = np.flatnonzero(size <= _LONG)
    k = 0
    while len(active := active[size[active] > k]):
        lane = lanes[starts[active] + k] & _KEEP[np.minimum(size[active] - k, 8)]
        h[active] = mix(h[active] ^ lane) + _GOLD
        k += 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return mix(h)


def hash_runs(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` consecutive word hashes (runs across documents too: see ``whole_runs``)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, seed, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + m]) * _M1
        h ^= h >> _S33
    return mix(h)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_runs(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which a run of ``n`` words of one document starts."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    long = np.diff(first) >= n
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:total]) > 0)
