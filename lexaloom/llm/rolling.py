"""Vectorised rolling hashes over concatenated texts (numpy, one pass per chunk).

A prefix sum of table[byte] * B**k (mod 2**64, B odd) gives the hash of any span as
(H[end] - H[start]) * B**-start; the result is mixed, so all 64 bits are usable.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: A second hash, independent of the first; together they have 128 bits.
OTHER = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_INV = {b: pow(b, -1, 1 << 64) for b in (BASE, OTHER)}
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done, step = 1, base
        while done < size:  # doubling: pow[done:2*done] = pow[:done] * base**done
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step & _MASK
        _POW[base] = have
        if size > 1 << 24:  # one huge document must not stay in the worker's memory
            del _POW[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TABLES = {BASE: TABLE, OTHER: mix(TABLE + np.uint64(OTHER))}


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """H with H[k] = sum of values[:k] * B**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def byte_prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    return prefix(_TABLES[base][data], base)


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Mixed hash of values[start:end] for arrays of starts and ends."""
    return mix((h[end] - h[start]) * _powers(_INV[base], len(h))[start])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of every window of ``size`` consecutive values."""
    n = len(h) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((h[size:] - h[:n]) * _powers(_INV[BASE], len(h))[:n])


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values, by block-wise running minima."""
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l) over all pairs."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)


def word_spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``separators`` (256 flags) doesn't mark."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of_texts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie side by side, and where each text's words begin; no word runs over an edge."""
    start, end = word_spans(data, separators)
    inner = np.unique(offsets[1:-1])
    if len(start) and len(inner):
        cut = inner[np.searchsorted(start, inner, side="left") > np.searchsorted(end, inner, side="right")]
        if len(cut):
            start, end = np.sort(np.append(start, cut)), np.sort(np.append(end, cut))
    return start, end, np.searchsorted(start, offsets, side="left")


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True
