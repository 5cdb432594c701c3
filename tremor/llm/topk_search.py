"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments; with a segment's mean m and deviation s (over w places),
its share of q . x is at most w * (m_q * m_x + s_q * s_x).  The same statistics bound the
Euclidean distance from below, w * ((m_q - m_x)^2 + (s_q - s_x)^2), for vectors of one
norm.  Levels go from few to many segments; a vector leaves a query once its bound is
under the k-th best exact score so far, and only survivors are multiplied out: pair by pair
where they are few, as one matrix product where they are many.

Queries are packed into blocks and vectors into chunks, both bounded by bytes.  Every block is
sent to every chunk of its length, no chunk is sent twice, and a chunk gives back k rows for
each query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep
from .integers import EXACT, as_long, floored, largest, order_key, products, whole

#: Queries of a block at most, and bytes of its components as doubles.
QUERY_BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Bytes of a chunk's components as doubles at most; smaller tables are cut into so many chunks, but not under so many vectors.
CHUNK_BYTES, CHUNKS, CHUNK = 32 << 20, 64, 2048
#: Queries and vectors that are compared as one matrix.
SLAB, TILE = 256, 4096
#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)
#: Share of survivors from which on a matrix product is faster than single pairs.
DENSE = 1 / 16
#: Sums of integers below this are exact in single precision.
SINGLE = 1 << 24


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(w) times means and deviations of the segments, side by side."""
    cut = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, e in zip(cut[:-1], cut[1:], strict=True):
        if e > a:
            part = x[:, a:e]
            out += [np.sqrt(e - a) * part.mean(axis=1), np.sqrt(e - a) * part.std(axis=1)]
    return np.stack(out, axis=1)


def _best(of: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, higher ones first, ties to smaller places."""
    rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    o = np.lexsort((at, -rank, of))
    o = o[np.arange(len(o)) - np.searchsorted(of[o], of[o]) < k]
    return of[o], at[o], score[o]


class _Scores:
    """Exact scores of queries and vectors, by one float64 product each while they stay below 2^53, else as
    Python integers (`integers.products`).

    q and x are what bounds are taken from: with Python integers, vectors scaled to components of at most 1."""

    def __init__(self, query: np.ndarray, x: np.ndarray):
        self.wide = largest(query) * largest(x) * x.shape[1] >= EXACT
        self.q, self.x = query, x
        if self.wide:
            self.unit, self.own = largest(x) or 1, np.abs(query).max(axis=1, initial=0)
            self.own[self.own == 0] = 1
            self.exact_q, self.exact_x = whole(query), whole(x)
            self.q, self.x = query / self.own[:, None], x / self.unit
        else:
            # no part of a sum is larger than the product of the norms
            norms = [np.sqrt(np.square(v).sum(axis=1).max(initial=0)) for v in (query, x)]
            kind = np.float32 if norms[0] * norms[1] < SINGLE - 1 else np.float64
            self.dense_q, self.dense_x = query.astype(kind), x.astype(kind)
        self.slack = 1e-9 * (1 + np.abs(self.q).max(initial=0) * np.abs(self.x).max(initial=0) * x.shape[1])

    def pairs(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.wide:
            out = np.zeros(len(of), dtype=object)
            for i in np.unique(of):
                here = of == i
                out[here] = products(self.exact_x[at[here]], self.exact_q[i][:, None])[:, 0]
            return out
        out, step = np.zeros(len(of)), max(1, (1 << 21) // self.x.shape[1])
        for a in range(0, len(of), step):
            out[a : a + step] = np.einsum("ij,ij->i", self.q[of[a : a + step]], self.x[at[a : a + step]])
        return out

    def bars(self, of: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Scores on the scale of the bounds."""
        if not self.wide:
            return score.astype(float)
        return np.array([int(n) / (int(self.own[i]) * self.unit) for i, n in zip(of, score, strict=True)], float)


def _left(s: _Scores, of: np.ndarray, stats: list, own: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """Which vectors the bounds leave to the queries, as a matrix.  own: from where to where a query's own rows stand."""
    n, unknown = len(s.x), np.isinf(limit).any()
    alive = np.ones((len(of), n), bool)
    for i in np.flatnonzero(own[:, 1] > own[:, 0]):
        alive[i, own[i, 0] : own[i, 1]] = False
    for level, (of_query, of_x) in enumerate(stats):
        bound = of_query[of] @ of_x.T
        if unknown and n >= k and (not level or np.count_nonzero(alive) > 4 * k * len(of)):  # a better limit from the most promising ones
            bound[~alive] = -np.inf
            some = np.argpartition(bound, n - k, axis=1)[:, n - k :]
            many = np.repeat(of, k)
            least = s.bars(many, s.pairs(many, some.ravel())).reshape(some.shape).min(axis=1)
            limit = np.where(np.take_along_axis(alive, some, axis=1).all(axis=1), np.maximum(limit, least), limit)
        alive &= bound >= (limit - s.slack)[:, None]
    return alive


def _pairs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _survivors(s: _Scores, of: np.ndarray, alive: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, vectors and exact scores of what is left; of a matrix product only those that reach the limits or are among the k highest."""
    if s.wide or np.count_nonzero(alive) < DENSE * alive.size:
        i, at = _pairs(alive)
        return of[i], at, s.pairs(of[i], at)
    score = s.dense_q[of] @ s.dense_x.T
    n = len(s.x)
    if n >= k and np.isinf(limit).any():
        score[~alive] = -np.inf
        limit = np.maximum(limit, np.partition(score, n - k, axis=1)[:, n - k])
    i, at = _pairs(alive & (score >= np.maximum(limit, np.finfo(score.dtype).min).astype(score.dtype)[:, None]))
    return of[i], at, score[i, at].astype(float)


def search(query: np.ndarray, query_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, levels=LEVELS):
    """Best k (score, id) of each query among x without the query's own row; ties to smaller ids.

    Vectors are whole numbers in floating point.  Scores are exact (`_Scores`).  Vectors go by in tiles,
    and what the earlier ones gave limits the later ones.
    Returns arrays query place, row place, score, and how many scores were multiplied out.
    """
    order, exact, query = np.argsort(x_id, kind="stable"), 0, query.astype(np.float64)
    levels = [n for n in levels if n <= x.shape[1]]
    plain = [_statistics(query, n) for n in levels]
    best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for first in range(0, len(x), TILE):
        rows = order[first : first + TILE]
        s = _Scores(query, x[rows].astype(np.float64))
        stats = list(zip([_statistics(s.q, n) for n in levels] if s.wide else plain, [_statistics(s.x, n) for n in levels], strict=True))
        own = np.stack([np.searchsorted(x_id[rows], query_id, side=side) for side in ("left", "right")], axis=1)
        limit, last = np.full(len(query), -np.inf), np.searchsorted(best[0], np.arange(len(query)), side="right")
        full = np.flatnonzero(np.bincount(best[0], minlength=len(query)) >= k)
        limit[full] = s.bars(full, best[2][last[full] - 1])
        found = [best]
        for a in range(0, len(query), SLAB):
            of = np.arange(a, min(len(query), a + SLAB))
            alive = _left(s, of, stats, own[of], limit[of], k)
            exact += np.count_nonzero(alive)
            of, at, score = _survivors(s, of, alive, limit[of], k)
            found.append((of, at + first, score))
        best = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
    return best[0], order[best[1]], best[2], exact


def _meet(k: int):
    def whole_column(b: pa.RecordBatch, name: str, row: int) -> np.ndarray:
        return b.column(name)[row].values.to_numpy()

    def vectors(b: pa.RecordBatch, name: str, row: int) -> np.ndarray:
        rows = b.column(name)[row].values
        return rows.flatten().to_numpy().reshape(len(rows), -1)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                q_id, key, x_id = (whole_column(b, name, row) for name in ("query_ids", "keys", "vec_ids"))
                of, at, score, _ = search(vectors(b, "queries", row), q_id, vectors(b, "vectors", row), x_id, k)
                if score.dtype == object:
                    n = [int(v) for v in score]
                    score, place = pa.array([as_long(v) for v in n], pa.int64()), [None if as_long(v) is not None else order_key(v) for v in n]
                    beyond = pa.array([0 if p is None else 1 if v > 0 else -1 for v, p in zip(n, place, strict=True)], pa.int32())
                else:
                    score, place, beyond = pa.array(score.astype(np.int64)), [None] * len(of), pa.array(np.zeros(len(of), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[of]), pa.array(q_id[of]), pa.array(x_id[at]), score, beyond, pa.array(place, pa.binary())],
                    ["key", "query_id", "vec_id", "score", "beyond", "place"],
                )

    return run


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of embeddings (vec_id, embedding) with the
    highest inner products with each row of queries (vec_id, embedding), itself (equal
    vec_id) left out; components count as floor(scale * x).

    Vectors that are null, empty, or hold a null, an infinity or NaN take no part, on either
    side, nor do rows without vec_id; vectors meet those of their own length only; ties go to
    the smaller vec_id; repeated rows are candidates each, a repeated query is answered once,
    queries that share a vec_id but not the vector are answered each for itself, and no row of
    its own vec_id is a candidate; fewer rows than k give all; empty tables give no rows; other
    columns are not read.  Scores are exact whatever the components' size; one that no long
    holds is ranked and null.
    """

    usable, values = floored("embedding", scale)

    def scaled(df: DataFrame) -> DataFrame:
        rows = df.where(usable & F.col("vec_id").isNotNull())
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).withColumn("d", F.size("v"))

    # a vector's chunk follows from its place in the table: rows of one id need not share a chunk
    vectors = keep(scaled(embeddings).withColumn("at", F.monotonically_increasing_id()), "vectors")
    asked = keep(scaled(queries).distinct(), "queries")

    def of_length(df: DataFrame, rows: str) -> DataFrame:
        return df.groupBy("d").agg(F.count("*").alias(rows), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias(f"{rows}_peak"))

    parts = lambda rows, size: F.ceil(F.col(rows) / F.greatest(F.lit(1), F.floor(F.lit(size) / (8 * F.col("d")))))
    lengths = keep(
        of_length(vectors, "rows").join(of_length(asked, "asked"), "d").select(
            "d", F.greatest(parts("rows", CHUNK_BYTES), F.least(F.lit(CHUNKS), F.ceil(F.col("rows") / CHUNK))).cast("int").alias("chunks"),
            F.greatest(parts("asked", BLOCK_BYTES), F.ceil(F.col("asked") / QUERY_BLOCK)).cast("int").alias("blocks"),
            F.greatest("rows_peak", "asked_peak").alias("peak"),
        ),
        "lengths",
    )
    # floats hold such components as doubles do
    kind = "array<float>" if (lengths.agg(F.max("peak")).first()[0] or 0) < SINGLE else "array<double>"

    def packed(df: DataFrame, into: str, by: list, *more: str) -> DataFrame:
        # lengths that differ need rows of as many components: a table has few
        rows = df.join(F.broadcast(lengths), "d").groupBy("d", F.pmod(F.xxhash64(*by), F.col(into)).cast("int").alias("part"), *more)
        # one list of structs: separate lists need not keep the same order
        return rows.agg(F.collect_list(F.struct("vec_id", F.col("v").cast(kind).alias("v"), F.xxhash64("vec_id", "v").alias("key"))).alias("rows"))

    blocks = keep(packed(asked, "blocks", ["vec_id", "v"], "chunks"), "blocks").select(
        "d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.col("rows.vec_id").alias("query_ids"), F.col("rows.v").alias("queries"), F.col("rows.key").alias("keys")
    )
    chunks = packed(vectors, "chunks", ["at"]).select("d", "part", F.col("rows.vec_id").alias("vec_ids"), F.col("rows.v").alias("vectors"))
    # Spark takes the blocks for as small as they are before they are sent to every chunk, and would broadcast them
    met = blocks.hint("merge").join(chunks, ["d", "part"]).select("queries", "query_ids", "keys", "vectors", "vec_ids")
    local = met.mapInArrow(_meet(k), "key long, query_id long, vec_id long, score long, beyond int, place binary")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("beyond"), F.desc("score"), F.desc("place"), "vec_id"))
    best = local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return keep(best, "best")  # once, however often it is read, and with small batches on the way to Python
