"""Whitening of embeddings with an exact covariance.

Components become integers; with n distinct vectors and sums S, c = n * x - S is an exact
integer vector, and n^3 times the covariance is the sum of c c^T.  Tasks cut c into digits so
small that float64 BLAS multiplies two slices of a block without rounding, put the slices'
products together as big integers, and give back one d x d matrix each, as digits again, which
Spark adds up.  What reaches the driver is that one matrix, bounded by the vectors' length;
its entries are rounded once, when they become doubles for the eigendecomposition.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .integers import largest, products, square_sums

#: Vectors multiplied at once; digits that travel between tasks; partial sums of the first merge.
ROWS, BITS, SALTS = 4096, 30, 64


def _matrices(b: pa.RecordBatch, column: str = "x"):
    """(places, integer matrix) of the vectors of each length in a batch."""
    values = b.column(column)
    size = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, flat[start[at][:, None] + np.arange(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: int64 if that is enough, else Python integers."""
    if n * largest(x.astype(object) if len(x) and x.min() == np.iinfo(np.int64).min else x) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _gram(fit: dict[int, tuple[int, list[int]]]):
    """The sum of c c^T over a task's vectors, a row of digits for each row of it."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b):
                for a in range(0, len(x), ROWS):
                    c = centred(x[a : a + ROWS], *fit[d])
                    total[d] = total.get(d, 0) + products(c.T, c).astype(object)
        for d, matrix in total.items():
            rest, sign, k = abs(matrix), np.where(matrix < 0, -1, 1), 0
            while not k or rest.any():
                digit = (rest & ((1 << BITS) - 1)).astype(np.int64) * sign
                rest = rest >> BITS
                salt = np.random.default_rng().integers(SALTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, k, np.int32)), pa.array(np.full(d, salt, np.int32)), pa.array(list(digit), pa.list_(pa.int64()))],
                    ["d", "row", "digit", "salt", "value"],
                )
                k += 1

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the rows of one place; digits stay below 2^63 for 2^33 of them."""
    out = [(*key, np.vstack(g["value"]).sum(axis=0)) for key, g in pdf.groupby(["d", "row", "digit"])]
    return pd.DataFrame(out, columns=["d", "row", "digit", "value"])


class Model:
    """Mean, leading components and spread of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int):
        d = len(sums)
        cube = n**3
        cov = np.array([[matrix[i, j] / cube for j in range(d)] for i in range(d)]).reshape(d, d)
        value, vector = np.linalg.eigh(cov)
        trace = sum(int(matrix[i, i]) for i in range(d)) / cube
        lead = range(d - 1, max(-1, d - 1 - components), -1)
        self.n, self.sums = n, sums
        # what rounding of the decomposition could make is no spread
        self.spread = [float(value[k]) if value[k] > 1e-12 * max(trace, 0) else 0.0 for k in lead]
        self.axes = np.array([vector[:, k] for k in lead]).T
        self.explained = [e / trace if trace else 0.0 for e in self.spread]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x - mean) on each component over the root of its spread, NaN without spread; and c."""
        c = centred(x, self.n, self.sums)
        away = c.astype(np.float64) / self.n if c.dtype != object else np.array([[v / self.n for v in r] for r in c.tolist()]).reshape(c.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.array(self.spread))
            return np.where(root > 0, (away @ self.axes) / root, np.nan), c


def _coordinates(models: dict[int, Model], components: int):
    def run(batches):
        for b in batches:
            for d, _, x in _matrices(b):
                z, _ = models[d].project(x)
                z = np.column_stack((z, np.full((len(z), components - z.shape[1]), np.nan)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), *(pa.array(z[:, k]) for k in range(components))], ["d", *(f"z{k}" for k in range(components))])

    return run


def _whitened(models: dict[int, Model], errors: dict[int, float]):
    def run(batches):
        for b in batches:
            for d, at, x in _matrices(b):
                m = models[d]
                z, c = m.project(x)
                many = z.shape[1]
                away = [Decimal(int(v)) if v < 10**38 else None for v in square_sums(c)]
                column = {
                    "vec_id": b.column("vec_id").take(pa.array(np.repeat(at, many))),
                    "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(x) * many, m.n)),
                    "deviation": pa.array([v for v in away for _ in range(many)], pa.decimal128(38, 0)),
                    "whitened": pa.array(z.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(m.explained, len(x))),
                    "identity_error": pa.array(np.full(len(x) * many, errors[d])),
                }
                yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    return run


def whiten(embeddings: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.

    A row of embeddings (vec_id, embedding) gives a row for each of the first `components`
    components, fewer if its vector is shorter.  x = floor(scale * c), which saturates at the
    ends of a long.  Mean and covariance are of the distinct x vectors; deviation is the sum
    of (n * x - S)^2, null beyond 38 digits; identity_error is the largest absolute entry
    of the whitened fit list's covariance minus the identity.

    Vectors that are null, empty, or hold nulls, NaN or infinities drop out; a null vec_id
    stays null; repeated rows and ties all get their rows but count once in the fit; vectors
    of each length are fitted for themselves; a component without spread (a single vector,
    dependent dimensions) has explained 0 and whitened null, and no part in identity_error;
    an empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long"))
    used = embeddings.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)))
    rows = keep(used.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "rows")
    fit = keep(rows.select("x").distinct(), "fit")
    place = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("place", "value"))
    fitted: dict[int, tuple[int, list[int]]] = {}
    for r in place.groupBy("d", "place").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(19,0)")).alias("total")).orderBy("d", "place").collect():
        fitted.setdefault(r["d"], (r["n"], []))[1].append(int(r["total"]))
    schema = "d int, row int, digit int, value array<long>"
    parts = fit.mapInArrow(_gram(fitted), "d int, row int, digit int, salt int, value array<long>")
    digits = parts.groupBy("d", "row", "salt").applyInPandas(_add, schema).groupBy("d", "row").applyInPandas(_add, schema).collect()
    matrices = {d: np.zeros((d, d), dtype=object) for d in fitted}
    for r in digits:
        matrices[r["d"]][r["row"]] += np.array([int(v) << (BITS * r["digit"]) for v in r["value"]], dtype=object)
    models = {d: Model(n, sums, matrices[d], components) for d, (n, sums) in fitted.items()}
    names = [f"z{k}" for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    moments = (
        fit.mapInArrow(_coordinates(models, components), "d int, " + ", ".join(f"{c} double" for c in names))
        .groupBy("d")
        .agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs))
        .collect()
    )
    errors = {}
    for r in moments:
        has = [k for k, e in enumerate(models[r["d"]].spread) if e > 0]
        errors[r["d"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in has and j in has), default=0.0)
    if not models:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return rows.mapInArrow(
        _whitened(models, errors),
        "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double",
    )
