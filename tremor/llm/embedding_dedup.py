"""Embedding near-deduplication through a pivot-permutation index.

Every vector is described by its PREFIX nearest of P reference points, in order.  It is
entered in the inverted list of each of these pivots (by label); two vectors are compared
if they share at least SHARED pivots whose places in the two orders differ by APART on
average at most, and linked by their cosine in double precision.  Equal vectors are one
class with a count, so copies are never expanded into pairs.

P follows the rows up to MOST_PIVOTS, the bounded sample on which the index is fitted, so
lists keep their length; a longer list is cut into blocks, and every two blocks of it meet
in a task of their own: whatever the size, all vectors are indexed and no list is capped.
Each of the commonest lengths has pivots of its own; vectors of other lengths, and all with
exact=True, are on one list a label and length, with all of its pairs.  A pair is owned by its smallest
shared pivot, so its link is counted once.  A task gives back link counts and a spanning
forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shuffle_partitions
from .components import connected_components

#: Nearest pivots that describe a vector, and how many two must share to be compared.
PREFIX, SHARED = 12, 3
#: Mean difference of the places of shared pivots, at most.
APART = 5.0
#: Vectors in a block of a list; lists aim at half of it.
BLOCK = 512
#: Pivots of a length at most, drawn from a bounded sample of its vectors.
MOST_PIVOTS = 4096
#: The commonest lengths that get pivots, if a label has more than a block of them; for the rest
#: every pair of a list is compared.
LENGTHS = 8


def _usable(column: str = "embedding"):
    """Vectors whose components are all there and finite, and not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _describe(pivots: dict[int, np.ndarray], prefix: int):
    """Rows with the ordered nearest pivots of each vector; those of a length without pivots are on list 0."""

    def run(batches):
        for b in batches:
            values = b.column("vector").to_pylist()
            dims = np.array([len(v) for v in values])
            near: list = [np.zeros(1, np.int32)] * len(values)
            for d in np.unique(dims):
                if int(d) in pivots:
                    at = np.flatnonzero(dims == d)
                    score = _unit([values[i] for i in at]) @ pivots[int(d)].T
                    for i, places in zip(at, np.argsort(-score, axis=1, kind="stable")[:, :prefix].astype(np.int32), strict=True):
                        near[i] = places
            yield pa.RecordBatch.from_arrays(
                [b.column("class"), b.column("label"), b.column("n"), b.column("vector"), pa.array(dims.astype(np.int32)), pa.array(near, pa.list_(pa.int32()))],
                ["class", "label", "n", "vector", "d", "near"],
            )

    return run


def _links(threshold: float, shared: int):
    """One block, or two, of one list: link counts of its vectors and a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["label", "d", "pivot", "first", "second"], sort=False):
            out += one(g.sort_values("class"))
        a, b, links = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": pd.array(links, "Int64")})

    def one(g: pd.DataFrame) -> list[tuple[int, int | None, int]]:
        name, n, part = g["class"].to_numpy(), g["n"].to_numpy(), g["part"].to_numpy()
        vector, near = _unit(g["vector"].tolist()), np.array(g["near"].tolist())
        pivot, first, second = (int(g[c].iloc[0]) for c in ("pivot", "first", "second"))
        codes, at = np.unique(near, return_inverse=True)
        has = np.zeros((len(g), len(codes)), np.float32)
        has[np.arange(len(g))[:, None], at.reshape(near.shape)] = 1
        place = np.zeros((len(g), len(codes)), np.float32)
        place[np.arange(len(g))[:, None], at.reshape(near.shape)] = np.arange(near.shape[1])

        def owned(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Of pairs that share pivots enough, those this list owns, of like order and near enough."""
            both = has[i] * has[j]
            mine = np.flatnonzero(codes[np.argmax(both, axis=1)] == pivot)
            i, j, both = i[mine], j[mine], both[mine]
            apart = (np.abs(place[i] - place[j]) * both).sum(axis=1) <= APART * both.sum(axis=1)
            near_enough = apart.copy()
            near_enough[apart] = np.einsum("ij,ij->i", vector[i[apart]], vector[j[apart]]) >= threshold
            return mine[near_enough]

        x, y = np.flatnonzero(part == first), np.flatnonzero(part == second)
        common = has[x] @ has[y].T >= min(shared, near.shape[1])
        if first == second:
            common &= x[:, None] < y[None, :]
        i, j = np.nonzero(common)
        i, j = x[i], y[j]
        linked = np.concatenate([np.zeros(0, np.int64), *(a + owned(i[a : a + 65536], j[a : a + 65536]) for a in range(0, len(i), 65536))])
        i, j = i[linked], j[linked]
        count = np.bincount(i, n[j], minlength=len(g)) + np.bincount(j, n[i], minlength=len(g))
        top = np.arange(len(g))
        forest = []

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                top[max(p, q)] = min(p, q)
                forest.append((int(name[a]), int(name[b]), 0))
        return forest + [(int(name[k]), None, int(count[k])) for k in np.flatnonzero(count)]

    return run


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.98, prefix: int = PREFIX, shared: int = SHARED, exact: bool = False) -> DataFrame:
    """One row for each row of embeddings (vec_id, embedding, label): vec_id, n_links,
    component_id, kept.

    Vectors are compared when their labels are equal and not null.  Null or empty vectors,
    zero ones, and those with null or infinite components or NaN link with nothing; vectors
    of different lengths are not compared, whatever lengths are rare; equal and repeated rows
    are linked; similarities that tie with the threshold are links; a null vec_id takes part
    and is never the smallest; an empty table gives no rows; other columns are not read.
    Vectors are taken as equal when their 64-bit hashes are.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = _usable() & F.col("label").isNotNull()
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    named = rows.withColumn("class", F.when(usable, F.xxhash64("label", plain)))
    classes = keep(
        named.where(F.col("class").isNotNull()).groupBy("class", "label").agg(F.count("*").alias("n"), F.first(plain).alias("vector")), "classes"
    )
    lengths = classes.groupBy("label", F.size("vector").alias("d")).count().groupBy("d").agg(F.sum("count").alias("all"), F.max("count").alias("most"))
    commonest = lengths.orderBy(F.desc("all"), "d").limit(LENGTHS).collect()
    if not commonest:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = {}
    for r in commonest if not exact else ():
        if r["most"] > BLOCK:
            p = int(min(MOST_PIVOTS, 2 * prefix * r["most"] // BLOCK + prefix))
            # a bounded sample, by a hash of the vector
            sample = classes.where(F.size("vector") == r["d"]).orderBy(F.xxhash64("class"), "class").limit(p).select("vector").collect()
            pivots[r["d"]] = _unit([x["vector"] for x in sample])
    near = keep(
        classes.select("class", "label", "n", "vector").mapInArrow(
            _describe(pivots, prefix), "class long, label string, n long, vector array<double>, d int, near array<int>"
        ),
        "near",
    )
    lists = near.withColumn("pivot", F.explode("near"))
    length = keep(lists.groupBy("label", "d", "pivot").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "lengths")
    meetings = length.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0]
    blocked = lists.join(length.drop("rows"), ["label", "d", "pivot"]).withColumn("part", F.pmod(F.xxhash64("class", "pivot"), "blocks").cast("int"))
    met = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class", "n", "vector", "near", "label", "d", "pivot", "part", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second")
    )
    tasks = max(shuffle_partitions(spark), 1)
    # buckets follow the work, so that one holds a few blocks however large the table is
    bucket = F.pmod(F.xxhash64("label", "d", "pivot", "first", "second"), F.lit(max(8 * tasks, meetings // (8 * BLOCK))))
    found = keep(
        met.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(_links(threshold, shared), "a long, b long, links long"),
        "links",
    )
    label = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    placed = named.select("vec_id", "class").join(label.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class"))
    least = placed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = (
        placed.join(least, "component", "left")
        .join(links, "class", "left")
        .join(classes.select("class", F.col("n").alias("copies")), "class", "left")
    )
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
