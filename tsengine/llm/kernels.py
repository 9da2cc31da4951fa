"""Vectorised hashing of UTF-8 text (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, 3 mod 4


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of a public 64-bit hash)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


#: A fixed 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(which: str, n: int) -> np.ndarray:
    have = _tables[which]
    if len(have) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        out = np.ones(max(n, 1 << 16), U)
        k = 1
        while k < len(out):
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
            k *= 2
        _tables[which] = have = out
    return have[:n]


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums from which the hash of any byte range follows; see `range_hashes`. values: of the bytes."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(values[data] * _powers("up", len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal strings have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers("down", len(sums))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def windows(sums: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Hashes of the `width`-byte strings that start at start, start + 1, ..., end - 1."""
    h = (sums[start + width : end + width] - sums[start:end]) * _powers("down", len(sums))[start:end]
    return mix(h + U(width * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of the words of all rows, and for each row the number of words before it (rows + 1 values).

    separators: 256 booleans. A word never crosses a row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = edges[edges > 0] - 1
    last[cut] = inside[cut]
    start = np.nonzero(first)[0]
    end = np.nonzero(last)[0] + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, or of all its words where it has fewer (none: nothing).

    rows: word offsets of the rows (rows + 1 values). Returns (hashes, offsets of the rows in them).
    """
    count = np.diff(rows)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(len(rows), np.int64)
    np.cumsum(many, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U), at
    step = U(0x9FB21C651E98DF25)
    # index of the first word of each shingle
    first = np.repeat(rows[:-1] - at[:-1], many) + np.arange(at[-1])
    short = np.repeat(count < k, many)
    h = np.zeros(at[-1], U)
    length = np.repeat(np.minimum(count, k), many)
    padded = np.concatenate([words, np.zeros(k, U)])
    for j in range(k):
        part = padded[first + j]
        h = h * step + (np.where(j < length, part, U(0)) if short.any() else part)
    return mix(h + length.astype(U)), at
