"""Vectorised text primitives on UTF-8 buffers: words, character n-grams, shingles and substring hashes.

A batch of texts is one byte array plus offsets (as Arrow stores it). The hash of any substring comes from two
entries of a prefix-sum array, so hashing every word, n-gram or 200-byte window costs a few array operations
per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: A random odd 64-bit value for each byte.
_BYTE = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, k = np.ones(1, np.uint64), 1
        while k < n:
            have, k = np.concatenate([have, have * U(pow(base, k, 1 << 64))]), k * 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; NULL counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes each: ``(first row, end row, bytes, offsets)``. A longer text is a run of its own."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Hasher:
    """Hashes of substrings of one byte array; another odd ``base`` gives other hashes."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(base, n), out=self.prefix[1:]) if n else None
        self.back = _power(pow(base, -1, 1 << 64), n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair."""
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of each substring of ``width`` bytes, by start."""
        if len(self.prefix) <= width:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:-width]) * self.back[: len(self.prefix) - width])


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: words are maximal runs of bytes other than ASCII white space; words of text ``i`` are ``first[i]:first[i+1]``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def char_starts(data: np.ndarray) -> np.ndarray:
    """Start of each code point, then the end of the array."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each text, and where each text's begin. A text with fewer words has its whole word sequence as one; one without words has none."""
    total, per = len(words), np.diff(first)
    factor = _power(0xD6E8FEB86659FD93, max(n, 1))
    if total >= n:
        rolled = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            rolled += words[j : total - n + 1 + j] * factor[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    count = np.where(per >= n, per - n + 1, np.minimum(per, 1))
    begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    out = np.empty(begin[-1], np.uint64)
    long = np.flatnonzero(per >= n)
    at = np.repeat(first[:-1], count) + (np.arange(begin[-1]) - np.repeat(begin[:-1], count))
    whole = np.repeat(per >= n, count)
    if len(long):
        out[whole] = rolled[at[whole]]
    for i in np.flatnonzero((per > 0) & (per < n)):
        own = words[first[i] : first[i + 1]]
        out[begin[i]] = mix(np.array([(own * factor[: len(own)]).sum(dtype=np.uint64) + U(len(own))], np.uint64) ^ U(0xA5A5A5A55A5A5A5A))[0]
    return out, begin


def gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``values[begin[i] : begin[i] + sizes[i]]``, one after the other."""
    end = np.cumsum(sizes)
    return values[np.repeat(begin - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)]


def lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of ``values`` cut at ``begin``."""
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
