"""Exact products of integer vectors and matrices in float64 BLAS, by slices of their digits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums below this are exact in double precision.
EXACT = 1 << 53


def floored(name: str, scale: int) -> tuple[Column, Column]:
    """Of a column of vectors: whether a vector takes part (there, not empty, no null, NaN or infinity,
    also when scaled), and floor(scale * x) of its components as doubles, -0.0 as 0.0."""
    scaled = F.transform(F.col(name).cast("array<double>"), lambda x: x * scale)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # from 2^52 on doubles have no fraction, and soon no long holds them
    down = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x) + 0.0)
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~F.coalesce(bad, F.lit(False)), down


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as int64, or as Python integers where one is too large for that."""
    if not x.size or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed digits of base 2^bits, low ones first, as doubles: x = sum of limb[k] << (bits * k)."""
    sign, rest, out = np.where(x < 0, -1.0, 1.0), abs(x), []
    while not out or rest.any():
        out.append((rest & ((1 << bits) - 1)).astype(np.float64) * sign)
        rest = rest >> bits
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integer matrices: int64 while every sum stays below 2^53, else Python integers.

    In the second case both sides are cut into digits small enough that the float64 product of
    two slices is exact, and the slices' products are put together as big integers.
    """
    inner = a.shape[1]
    if largest(a) * largest(b) * inner < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    bits = max(1, (53 - inner.bit_length()) // 2)
    out = np.zeros((a.shape[0], b.shape[1]), dtype=object)
    right = [(k, y) for k, y in enumerate(limbs(b, bits)) if y.any()]
    for j, x in enumerate(limbs(a, bits)):
        if x.any():
            for k, y in right:
                out = out + ((x @ y).astype(np.int64).astype(object) << (bits * (j + k)))
    return out


def square_sums(x: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact; Python integers where int64 could overflow."""
    if largest(x) ** 2 * x.shape[1] < 1 << 63:
        return (x * x).sum(axis=1)
    bits = max(1, (53 - x.shape[1].bit_length()) // 2)
    cut, out = limbs(x, bits), np.zeros(len(x), dtype=object)
    for j, a in enumerate(cut):
        for k, b in enumerate(cut[: j + 1]):
            out = out + ((a * b).sum(axis=1).astype(np.int64).astype(object) << (bits * (j + k))) * (1 + (j != k))
    return out


def order_key(n: int) -> bytes:
    """Bytes that sort like the integers, whatever their size."""
    size = (abs(n).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + key if n >= 0 else b"\0" + bytes(255 - c for c in key)


def as_long(n: int) -> int | None:
    """n, or nothing if it does not fit a long."""
    return int(n) if -(1 << 63) <= n < 1 << 63 else None
