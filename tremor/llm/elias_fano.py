"""Elias-Fano sequences and an n-gram trie of memory-mapped levels (numpy, inside tasks)."""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
_CHUNK = 1 << 16


class EliasFano:
    """A monotone sequence below 2^63: width low bits of each value as they are, the rest in unary.

    Two byte arrays (low, high), which may lie in mapped memory.  Searches use the places of
    the zeros among the high bits, found once when the first search comes.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._zeros: np.ndarray | None = None
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        low = []
        for i in range(0, n if width else 0, _CHUNK):
            part = values[i : i + _CHUNK]
            rows = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
            low.append(np.packbits(rows.ravel(), bitorder="little"))
        flags = np.zeros(n + (top >> width) + 2, bool)
        flags[(values >> U(width)).astype(np.int64) + np.arange(n)] = True
        pad = np.zeros(8, np.uint8)  # eight bytes are read at once
        return cls(n, width, np.concatenate([*low, pad]), np.packbits(flags, bitorder="little"))

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high, bitorder="little")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        p = i * self.width
        return (words[p >> 3] >> (p & 7).astype(U)) & U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions i."""
        if self._ones is None:
            self._ones = np.flatnonzero(self._bits())
        i = np.asarray(i, np.int64)
        return (self._ones[i] - i).astype(U) << U(self.width) | self._low(i)

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        return self.access(np.arange(self.n))

    def successor(self, first: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each range first..end the first position whose value is at least the target, or end.

        The zeros around the target's high part bound the values that share it; among these the
        low bits are halved, all searches together."""
        if self._zeros is None:
            self._zeros = np.flatnonzero(self._bits() == 0)
        target = np.asarray(target, U)
        high = np.minimum(target >> U(self.width), U(len(self._zeros) - 1)).astype(np.int64)
        beyond = (target >> U(self.width)) > U(len(self._zeros) - 1)
        # zero number h - 1 stands before the first value with high part h, zero number h behind the last
        at = np.where(high > 0, self._zeros[np.maximum(high - 1, 0)] - high + 1, 0)
        stop = np.minimum(self._zeros[high] - high, end)
        at = np.where(beyond, self.n, np.maximum(at, first))
        low = target & U((1 << self.width) - 1)
        open_ = np.flatnonzero(at < stop)
        while open_.size:
            middle = (at[open_] + stop[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < stop[open_]]
        return np.minimum(at, end)


#: log10 probabilities in 255 steps down to 10^-LOWEST; code 0 is "not there".
LOWEST = 8.0


def quantise(log10: np.ndarray) -> np.ndarray:
    return (255 - np.clip(np.round(-log10 * 254 / LOWEST), 0, 254)).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    table = np.concatenate(([0.0], 10.0 ** -((255 - np.arange(1, 256)) * LOWEST / 254)))
    return table[code]


class NgramTrie:
    """Contexts (63-bit names), pointers into their successors, quantised probabilities.

    Successors have numbers in a level of their own (sorted 63-bit names of all words that
    follow anything), so context place * words + number is monotone and no two words share a
    name.  All levels lie in one region of mapped memory, without a file.
    """

    def __init__(self, contexts: np.ndarray, counts_of: np.ndarray, context_ix: np.ndarray, successor: np.ndarray, count: np.ndarray):
        """contexts sorted, counts_of their totals; the others one entry a pair, sorted by (context_ix, successor)."""
        pointers = np.searchsorted(context_ix, np.arange(len(contexts) + 1))
        code = quantise(np.log10(count / counts_of[context_ix])) if len(count) else np.zeros(0, np.uint8)
        names, number = np.unique(successor, return_inverse=True)
        parts = [EliasFano.build(x) for x in (contexts, names, pointers, context_ix.astype(U) * U(len(names)) + number.astype(U))]
        arrays = [a for p in parts for a in (p.low, p.high)] + [code]
        cut = np.cumsum([0, *map(len, arrays)])
        mapped = np.frombuffer(mmap.mmap(-1, int(cut[-1]) + 1), np.uint8)
        for a, at in zip(arrays, cut[:-1], strict=True):
            mapped[at : at + len(a)] = a
        views = [mapped[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.levels = [EliasFano(p.n, p.width, views[2 * k], views[2 * k + 1]) for k, p in enumerate(parts)]
        self.code, self.size = views[-1], int(cut[-1])

    @staticmethod
    def _find(level: EliasFano, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of names in a level, and whether they are there."""
        n = len(name)
        at = level.successor(np.zeros(n, np.int64), np.full(n, level.n), name)
        hit = at < level.n
        hit[hit] = level.access(at[hit]) == name[hit]
        return at, hit

    def lookup(self, context: np.ndarray, run: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 where not stored: run[i] successors in turn belong to context[i].

        Each context is found once and opens its pointer range; a successor search inside that
        range answers for each of its words."""
        names, words, pointers, pairs = self.levels
        ix, hit = self._find(names, context)
        first, end = np.zeros((2, len(context)), np.int64)
        first[hit], end[hit] = pointers.access(ix[hit]), pointers.access(ix[hit] + 1)
        distinct, back = np.unique(successor, return_inverse=True)
        number, known = self._find(words, distinct)
        of = np.repeat(np.arange(len(context)), run)
        ask = np.flatnonzero(hit[of] & known[back])
        key = ix[of[ask]].astype(U) * U(words.n) + number[back[ask]].astype(U)
        found = pairs.successor(first[of[ask]], end[of[ask]], key)
        inside = found < end[of[ask]]
        inside[inside] = pairs.access(found[inside]) == key[inside]
        out = np.zeros(len(successor), np.uint8)
        out[ask[inside]] = self.code[found[inside]]
        return out
