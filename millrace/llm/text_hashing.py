"""Vectorised hashes of the words of many texts, for use inside Arrow tasks.

The texts of an Arrow batch lie in one buffer. Words are found by byte class, and a word's hash
comes from prefix sums of ``table[byte] * base ** position`` modulo 2**64, so no text is split
into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 18

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]``
NOT_SPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing
ALPHANUMERIC = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the SplitMix64 constants)."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


_table = mix(np.arange(1, 257, dtype=U))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(kind: str, n: int) -> np.ndarray:
    """BASE ** 0..n-1, or the inverses, modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        factor = np.full(max(n, 2 * len(have)), U(BASE if kind == "up" else pow(BASE, -1, 1 << 64)))
        factor[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(factor)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each row's offsets in them; a null row is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes; a longer row stands alone."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of the lower-cased texts, and the rows' bounds among the words."""
    data = _lower[data]
    inside = word[data]
    row_starts = ends[:-1][ends[:-1] < len(data)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[row_starts] = inside[row_starts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = ends[1:][(ends[1:] > 0)] - 1
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_table[data] * powers("up", len(data)), out=sums[1:])
        h = mix((sums[end] - sums[start]) * powers("down", len(data) + 1)[start])
    return h, start, end, np.searchsorted(start, ends)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    if len(h) < n:
        return np.empty(0, U)
    out = np.full(len(h) - n + 1, U(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * U(BASE) + h[j : len(h) - n + 1 + j]
    return mix(out)
