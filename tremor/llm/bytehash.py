"""Vectorised polynomial fingerprints of byte ranges, words and shingles (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Two families of fingerprints; the bases are odd, so they have inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C55, 0xD1B54A32D192ED03)
#: Texts are hashed in slices of about so many bytes, whatever the batch size.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U(33))) * _M1
    x = (x ^ (x >> U(33))) * _M2
    return x ^ (x >> U(33))


_BYTE = [mix(np.arange(1, 257, dtype=U) * U(x)) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = [(np.ones(1, dtype=U), np.ones(1, dtype=U))] * 2


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[family][0]) < n:
        size, found = max(n, SLICE + (1 << 16)), []
        for base in (_BASES[family], pow(_BASES[family], -1, 1 << 64)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            found.append(np.cumprod(x))
        _pow[family] = tuple(found)
    return _pow[family]


class Ranges:
    """Fingerprints of any byte ranges of one buffer in constant time each."""

    def __init__(self, buf: np.ndarray, family: int = 0):
        n = len(buf)
        power, self.inverse = _powers(n + 1, family)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE[family][buf] * power[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + hi.astype(U) - lo.astype(U))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def _bounds(buf: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer; words also end where a row starts."""
    word = ~_SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = starts_at[(starts_at > 0) & (starts_at < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _segment(buf: np.ndarray, starts_at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the words of a buffer."""
    s, e = _bounds(buf, starts_at)
    return s, Ranges(_LOWER[buf] if fold else buf).of(s, e)


def words(data: np.ndarray, at: np.ndarray, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs i..j of rows: i, j, fingerprints of their words [^\\x20\\x09-\\x0D]+ (A-Z
    lower-cased if fold), and n + 1 offsets into these.  A row longer than a slice is cut between words."""
    for i, j in slices(at):
        lo, hi = int(at[i]), int(at[j])
        if hi - lo <= 2 * SLICE or j > i + 1:
            rows = at[i : j + 1] - lo
            s, h = _segment(data[lo:hi], rows, fold)
            yield i, j, h, np.searchsorted(s, rows)
            continue
        found = []
        while lo < hi:
            end = min(lo + SLICE, hi)
            while end < hi and not _SPACE[data[end]]:
                gap = np.flatnonzero(_SPACE[data[end : end + SLICE]])
                end = end + int(gap[0]) if len(gap) else min(end + SLICE, hi)
            found.append(_segment(data[lo:end], np.zeros(0, np.int64), fold)[1])
            lo = end
        h = np.concatenate(found)
        yield i, j, h, np.array([0, len(h)])


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hashes of every `length` neighbouring word fingerprints, in order."""
    n = len(h) - length + 1
    out = np.zeros(max(0, n), dtype=U)
    for a in range(0, n, SLICE):
        e = min(n, a + SLICE)
        power, inverse = _powers(e - a + length, 1)
        sums = np.zeros(e - a + length, dtype=U)
        np.cumsum(h[a : e + length - 1] * power[: e - a + length - 1], out=sums[1:])
        out[a:e] = mix((sums[length:] - sums[:-length]) * inverse[: e - a])
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit values; a shorter text is one."""
    if not len(h):
        return h
    w = min(k, len(h))
    x = np.zeros(len(h) - w + 1, dtype=U)
    for d in range(w):
        x = mix(x + h[d : len(h) - w + 1 + d] + U(d + 1))
    return np.unique(x)
