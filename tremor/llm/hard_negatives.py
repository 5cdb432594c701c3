"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M at least the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q
becomes (q, 0); then |q' - x'|^2 = M^2 + |q|^2 - 2 q . x, so higher inner products are
smaller distances and a window of scores is an annulus.  A tree holds, for each node, a
vantage point and the least and largest distance to it on either side.  A search takes nodes
nearest first, leaves out those inside or outside the annulus by the triangle inequality, and
ends as soon as nothing nearer than the k-th row found can come.

Vectors are dealt into chunks by a hash; each chunk gets a tree once, and every block of
anchors meets every tree, first for the positives, then for the windows that these give.
A task holds one tree and one block.  Distances only rule out; scores are exact integers
(`integers.products`), whatever the size of the components.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep
from .integers import EXACT, as_long, floored, order_key, products, whole

#: Vectors of a tree, anchors of a block, vectors of a leaf.
CHUNK, BLOCK, LEAF = 4096, 256, 256
_NODE = ("first", "end", "near", "far", "near_lo", "near_hi", "far_lo", "far_hi")


class Tree:
    """A vantage-point tree: rows in tree order, scaled to components of at most 1, and its nodes."""

    def __init__(self, x: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.raw, self.order, self.nodes = x, order, nodes
        self.unit = float(np.abs(x).max(initial=0)) or 1.0
        self.scaled = x / self.unit
        self.exact: np.ndarray | None = None  # integers, once doubles do not do
        self.square = float((self.scaled**2).sum(axis=1).max(initial=0))
        self.inner = np.flatnonzero(nodes[:, 2] >= 0)  # nodes with a vantage point, which is their first row
        self.vantage = nodes[self.inner, 0].astype(int)

    @classmethod
    def grow(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """Split at the median distance from a row far from the first one, down to `leaf` rows."""
        scaled = x / (float(np.abs(x).max(initial=0)) or 1.0)
        square = (scaled**2).sum(axis=1)
        y = np.column_stack((scaled, np.sqrt(np.maximum(0, square.max(initial=0) - square))))
        order, nodes = np.arange(len(x)), []

        def split(a: int, b: int) -> int:
            at = len(nodes)
            nodes.append([a, b, -1, -1, 0, 0, 0, 0])
            if b - a > max(leaf, 2):
                part = order[a:b]
                v = int(np.argmax(((y[part] - y[part[0]]) ** 2).sum(axis=1)))
                part[[0, v]] = part[[v, 0]]
                d = np.sqrt(((y[part[1:]] - y[part[0]]) ** 2).sum(axis=1))
                by = np.argsort(d, kind="stable")
                order[a + 1 : b], d = part[1:][by], d[by]
                mid = (len(d) + 1) // 2
                near, far = split(a + 1, a + 1 + mid), split(a + 1 + mid, b)
                nodes[at] = [a, b, near, far, d[0], d[mid - 1], d[mid], d[-1]]
            return at

        if len(x):
            split(0, len(x))
        return cls(x[order], order, np.array(nodes, float).reshape(-1, len(_NODE)))

    def search(self, q: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list[tuple], k: int) -> tuple[list[list], int]:
        """For each window (lowest, highest score, None for no end), its k best rows (-score, id,
        row) among the allowed; and how many rows were multiplied out.  Ties go to smaller ids."""
        unit = float(np.abs(q).max(initial=0)) or 1.0
        size = q / unit
        scale = (int(unit), int(self.unit))  # a score is this product times its scaled form
        total = self.square + float(size @ size)
        slack = 1e-9 * (1 + total)
        wide = scale[0] * scale[1] * len(q) >= EXACT
        if wide:
            self.exact = whole(self.raw) if self.exact is None else self.exact
            exact_q = whole(q)[:, None]

        def scaled(score) -> float:
            return score if isinstance(score, float) else score / (scale[0] * scale[1])

        found: list[list] = [[] for _ in windows]
        ends = [(-math.inf if lo is None else lo, math.inf if hi is None else hi) for lo, hi in windows]
        need = [math.inf if lo > hi else lo for lo, hi in ends]  # a row below it is of no use to the window
        top = max((hi for _, hi in ends), default=-math.inf)
        highest = scaled(top) + slack
        wanted = [scaled(n) for n in need]
        met = 0

        def visit(rows: slice | np.ndarray) -> None:
            nonlocal met
            score = products(self.exact[rows], exact_q)[:, 0] if wide else self.raw[rows] @ q
            met += len(score)
            use = np.flatnonzero(allowed[rows] & (score >= min(need, default=math.inf)) & (score <= top))
            at = use + rows.start if isinstance(rows, slice) else rows[use]
            for s, r in sorted(zip((-int(s) for s in score[use]), at.tolist(), strict=True)):
                if -s < min(need):
                    break
                for w, (lo, hi) in enumerate(ends):
                    if need[w] <= -s <= hi:
                        bisect.insort(found[w], (s, int(ids[r]), r))
                        del found[w][k:]
                        if len(found[w]) == k:
                            need[w] = max(lo, -found[w][-1][0])
                            wanted[w] = scaled(need[w])

        def best(distance: float) -> float:
            return (total - distance * distance) / 2

        visit(self.vantage)
        to_vantage = np.zeros(len(self.nodes))
        to_vantage[self.inner] = np.sqrt(np.maximum(0, total - 2 * (self.scaled[self.vantage] @ size)))
        heap = [(0.0, math.inf, 0)] if len(self.nodes) and windows else []
        while heap:
            low, high, at = heapq.heappop(heap)
            if best(low) + slack < min(wanted):
                break
            if best(high) - slack > highest:
                continue
            a, b, near, far, near_lo, near_hi, far_lo, far_hi = self.nodes[at]
            if near < 0:
                visit(slice(int(a), int(b)))
                continue
            d = to_vantage[at]
            for child, lo, hi in ((near, near_lo, near_hi), (far, far_lo, far_hi)):
                heapq.heappush(heap, (max(low, d - hi, lo - d), min(high, d + hi), int(child)))
        return found, met


def _plant(batches):
    """A tree for each chunk."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            x = np.vstack(row.vectors).astype(np.float64)
            tree = Tree.grow(x)
            yield pd.DataFrame(
                {
                    "d": [row.d],
                    "chunk": [row.chunk],
                    "ids": [np.asarray(row.ids)[tree.order]],
                    "labels": [np.asarray(row.labels)[tree.order]],
                    "vectors": [tree.raw.tobytes()],
                    "nodes": [tree.nodes.tobytes()],
                }
            )


def _meet(k: int, same: bool):
    """Rows that a block of anchors finds in a tree: of the anchor's label without end, or of others inside its windows."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, labels = np.asarray(row.ids), np.asarray(row.labels)
                x = np.frombuffer(row.vectors, np.float64).reshape(len(ids), -1)
                tree = Tree(x, np.arange(len(ids)), np.frombuffer(row.nodes, np.float64).reshape(-1, len(_NODE)))
                out = []
                for a in row.anchors:
                    windows, of = [(None, None)], [(None, None)]
                    if not same:
                        of = [(p["positive_id"], p["positive"]) for p in a["positives"]]
                        score = [int(p) for _, p in of]
                        windows = [(-(-s // 2), 95 * s // 100) for s in score]
                    allowed = ((labels == a["label"]) == same) & (ids != a["anchor_id"])
                    found, _ = tree.search(np.array(a["v"], np.float64), allowed, ids, windows, k)
                    for (positive_id, positive), rows in zip(of, found, strict=True):
                        out += [(a["anchor"], a["anchor_id"], positive_id, positive, i, as_long(-s), str(-s), order_key(-s)) for s, i, _ in rows]
                if out:
                    yield pd.DataFrame(dict(zip(_FOUND, map(list, zip(*out, strict=True)), strict=True))).astype({"positive_id": "Int64", "score": "Int64"})

    return run


_FOUND = ("anchor", "anchor_id", "positive_id", "positive", "id", "score", "exact", "place")
_FOUND_SCHEMA = "anchor long, anchor_id long, positive_id long, positive string, id long, score long, exact string, place binary"


def labelled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Distinct vec_id, label, v (floor(scale * x) as doubles) of the rows that take part."""
    usable, v = floored("embedding", scale)
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
        .distinct()
    )


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors are vec_id, label, v as `labelled` gives them.  An anchor's positives are
    the rows of its label with the highest inner products, ties to the smaller vec_id; for
    each, the negatives are the best rows of other labels whose score is from 50 to 95 % of
    the positive's (so none if that is below zero).

    Null ids, labels, vectors and components, NaN, infinities, empty vectors and components
    that overflow a double when scaled take no part; repeated rows count once; vectors meet
    those of their own length; no row of the anchor's own vec_id is found; anchors that share
    a vec_id but not the vector are searched each for itself; fewer rows than wanted give all;
    empty tables give none.  Scores beyond a long are ranked exactly and returned as null.
    """
    chunks, blocks = max(1, -(-rows.count() // CHUNK)), max(1, -(-anchors.count() // BLOCK))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    sized = rows.withColumn("d", F.size("v"))
    forest = keep(
        sized.groupBy("d", deal(chunks, "vec_id", "v").alias("chunk"))
        .agg(F.collect_list("vec_id").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list("v").alias("vectors"))
        .mapInPandas(_plant, "d int, chunk int, ids array<long>, labels array<string>, vectors binary, nodes binary"),
        "forest",
    )
    asked = anchors.withColumn("anchor", F.xxhash64("vec_id", "label", "v")).withColumn("d", F.size("v")).withColumnRenamed("vec_id", "anchor_id")

    def meet(asked: DataFrame, columns: list[str], k: int, same: bool) -> DataFrame:
        """The k best of each tree, then of all, for each anchor and positive."""
        packed = keep(asked.groupBy("d", deal(blocks, "anchor").alias("block")).agg(F.collect_list(F.struct(*columns)).alias("anchors")), "blocks")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # every tree meets every block in a task of their own: dealt by both, whatever the number of either
        met = forest.withColumn("block", every(blocks)).join(packed.withColumn("chunk", every(chunks)).hint("merge"), ["d", "block", "chunk"])
        local = met.select("ids", "labels", "vectors", "nodes", "anchors").mapInPandas(_meet(k, same), _FOUND_SCHEMA)
        rank = F.row_number().over(W.partitionBy("anchor", "positive_id", "positive").orderBy(F.desc("place"), "id"))
        return local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    best = keep(meet(asked, ["anchor", "anchor_id", "label", "v"], positives, True), "positives")
    of = best.groupBy("anchor").agg(F.collect_list(F.struct(F.col("id").alias("positive_id"), F.col("exact").alias("positive"))).alias("positives"))
    found = meet(asked.join(of, "anchor"), ["anchor", "anchor_id", "label", "v", "positives"], negatives, False)
    return found.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        F.expr("try_cast(positive AS long)").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
