"""Vectorised hashing of UTF-8 text held in Arrow buffers: words, word windows, byte n-grams.

All sums are modulo 2**64. A byte string hashes to sum(TABLE[b_j] * BASE**j); two bases and
tables give two values that are used together where an identity has to be exact.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
U = np.uint64
_libc = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _tables() -> list[np.ndarray]:
    rng = np.random.default_rng(20240229)
    return [rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in BASES]


TABLES = _tables()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit over the whole value."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = 500_000):
    """Ranges (lo, hi) of documents of about ``most`` bytes together; a longer one is alone. Small enough for the arrays of a chunk to stay in a core's cache."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def tidy() -> None:
    """Give memory that is free but held back to the system: workers live on between tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive documents: byte bounds, document, hashes. ``between`` marks other separators."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: int = 2, lower: bool = False, between: np.ndarray = SPACE):
        n = len(data)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        word = ~between[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        self.data = data
        inner = word[1:] & word[:-1] & ~first[1:n] if n else word
        start, end = word.copy(), word.copy()
        if n > 1:
            start[1:] &= ~inner
            end[:-1] &= ~inner
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hashes = [self._hash(i) for i in range(hashes)]

    def _hash(self, i: int) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(TABLES[i][self.data] * powers(BASES[i], n), out=total[1:])
        back = powers(_inverse(BASES[i]), n + 1)
        return mix((total[self.end] - total[self.start]) * back[self.start])

    def windows(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts (as word numbers) of the k-word windows inside one document, and their hashes."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in self.hashes]
        at = np.flatnonzero(self.doc[: n] == self.doc[k - 1 :])
        out = []
        for i, h in enumerate(self.hashes):
            total = np.zeros(n, dtype=np.uint64)
            for j, p in enumerate(powers(BASES[1 - i], k)):
                total += h[j : j + n] * p
            out.append(mix(total)[at])
        return at, out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes, across document bounds."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(TABLES[0][data] * powers(BASES[0], n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_inverse(BASES[0]), n - k + 1))


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask over n places of those in [s, s + length) for any s."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
