"""N-gram Jaccard join by a partitioned universe.

A text is the set of its distinct k-word shingles, named by 64-bit fingerprints.  The
universe of fingerprints is cut into m equal segments; m depends on the size band of the
smaller set of a pair, so a larger set is indexed under the bands of all sizes that it
may be linked with.  Two linked sets differ in at most H elements.

* Small bands (H <= ONE_DELETION_H): m = ceil((H + 1) / 2) segments.  Some segment then
  differs by at most one element, so each segment is indexed whole and with each one
  element left out; a whole segment meets a whole or a shortened one.
* Other bands: m segments, more than H + 1, of which at least m - H are equal, H now by
  the pair's own sizes.  Ordered by how many sets hold a segment, the H + 1 cheapest
  segments of two linked sets have one in common.  Those that only one set holds cost
  nothing, so most texts index nothing at all, and empty or very frequent segments are
  left out.  Before sets are fetched, a pair must have m - H segments in common.

Equal sets are one node throughout.  Every candidate is verified with its whole sets.
Inside a signature's group the member that shares most is compared with all others
first; later only members of different components meet, so a group of g near copies
costs about g comparisons, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bytehash import binary, mix, shingle_set, words
from .common import doc_id_of, join_small, keep, shuffle_partitions, with_fresh_key, with_row_key
from .components import connected_components

U = np.uint64
BAND_RATIO = 1.5
ONE_DELETION_H = 4
#: Share of further segments, from which the most frequent ones are left out.
SLACK = 0.3
#: The cheapest segments of a set that its rows carry, to tell where two sets met before.
HEAD = 16
#: Sets of up to so many shared segments carry 16-bit names of these, which rule out most pairs where they would
#: be made; those of more meet without and are sorted out by their whole lists.
SHORT_NAMES = 256
#: Members of one signature that meet in one task; a larger group meets block by block.
BLOCK = 512


def _band_edges(most: int) -> list[int]:
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return edges


class Scheme:
    """Segments of one size band for similarities of at least percent / 100."""

    def __init__(self, band: int, low: int, high: int, percent: int):
        self.band, self.low, self.end = band, low, high
        self.high = (high - 1) * 100 // percent  # the largest set that one of this band may be linked with
        self.differ = (100 - percent) * (high - 1 + self.high) // (100 + percent)
        self.deletion = self.differ <= ONE_DELETION_H
        need = self.differ + 1
        self.m = -(-need // 2) if self.deletion else need + max(2, int(need * SLACK))
        self.edges = np.array([(s << 64) // self.m for s in range(1, self.m)], dtype=U)

    def signatures(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signature and whether an element was left out, for a sorted set."""
        cut = np.concatenate(([0], np.searchsorted(found, self.edges), [len(found)]))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(found ^ U(0x5851F42D4C957F2D)))))
        salt = np.arange(self.m, dtype=U) * U(0x9E3779B97F4A7C15) + U(self.band + 1)
        whole = sums[cut[1:]] - sums[cut[:-1]]
        out, less = mix(whole + mix(salt)), np.zeros(self.m, bool)
        if self.deletion and len(found):
            of = np.repeat(np.arange(self.m), np.diff(cut))
            out = np.concatenate((out, mix(whole[of] - np.diff(sums) + mix(salt[of]))))
            less = np.arange(len(out)) >= self.m
        return out, less


def _schemes(percent: int):
    """Band k -> Scheme, and a set size -> the schemes it is indexed under."""
    made: dict[int, Scheme] = {}
    edges = _band_edges(1 << 40)

    def of(size: int) -> list[Scheme]:
        last = int(np.searchsorted(edges, size, side="right")) - 1
        out = []
        for k in range(last, -1, -1):
            if (edges[k + 1] - 1) * 100 // percent < size:
                break
            if k not in made:
                made[k] = Scheme(k, edges[k], edges[k + 1], percent)
            out.append(made[k])
        return out

    return of


def _sets(k: int):
    """Row keys, size and fingerprint of each text's set."""

    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            n, name = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U)
            for i, j, h, o in words(data, at):
                for r in range(i, j):
                    found = shingle_set(h[o[r - i] : o[r - i + 1]], k)
                    n[r] = len(found)
                    name[r] = mix(mix(found).sum(keepdims=True) + U(len(found)))[0]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), pa.array(n), pa.array(name.view(np.int64))], ["k1", "k2", "n", "node"]
            )

    return run


def _index(k: int, percent: int):
    """Signatures of each text: node, band, slack (segments to leave out; 0: none), less (an element
    left out), m (segments of the band), own (whether the set itself is of the band)."""

    def run(batches):
        schemes = _schemes(percent)
        for b in batches:
            data, at = binary(b.column("bytes"))
            for i, j, h, o in words(data, at):
                sigs, meta, count = [], [], []
                for r in range(i, j):
                    found = shingle_set(h[o[r - i] : o[r - i + 1]], k)
                    if not len(found):
                        continue
                    name = mix(mix(found).sum(keepdims=True) + U(len(found))).view(np.int64)[0]
                    n = len(found)
                    differ = (100 - percent) * (n + n * 100 // percent) // (100 + percent)
                    for s in schemes(n):
                        out, less = s.signatures(found)
                        sigs.append(out)
                        count.append((s.m, len(out) - s.m))
                        meta.append((name, s.band, 0 if s.deletion else s.m - min(differ, s.differ) - 1, s.m, n >= s.low and n < s.end))
                if not sigs:
                    continue
                total = [a + c for a, c in count]
                name, band, slack, m, own = (np.repeat(np.array(x), total) for x in zip(*meta, strict=True))
                less = np.repeat(np.tile([False, True], len(count)), np.array(count).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sigs).view(np.int64)),
                        pa.array(name.astype(np.int64)),
                        pa.array(band.astype(np.int16)),
                        pa.array(slack.astype(np.int32)),
                        pa.array(less),
                        pa.array(m.astype(np.int32)),
                        pa.array(own),
                    ],
                    ["sig", "node", "band", "slack", "less", "m", "own"],
                )

    return run


def _packed(k: int):
    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            for i, j, h, o in words(data, at):
                sets = [shingle_set(h[o[r - i] : o[r - i + 1]], k).tobytes() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for n, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[n] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], ["a", "b", "linked"])

    return run


def _dealt(members: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of members (sig, node, blocks, ..) once for each block they meet: own is theirs, other the one met.

    A group of g members costs g * g / BLOCK rows in place of one task with g * g comparisons.
    """
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return members.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs (doc_id, text).

    members: k1, k2 (row keys), n (set size), node; texts with equal sets share a node.
    links: a, b, linked: compared nodes, linked when 100 * intersection >= percent * union.
    Nodes linked directly or through others are connected by the links returned; two
    nodes of one component need not have been compared.
    """
    if not 50 < percent <= 100 or k < 1:
        raise ValueError("percent must be above 50 and at most 100, k positive")
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", "k2", F.col("text").cast("binary").alias("bytes"))
    members = keep(texts.mapInArrow(_sets(k), "k1 long, k2 long, n long, node long"), "members")
    nodes = members.where("n > 0").groupBy("node", "n").agg(F.min(F.struct("k1", "k2")).alias("one"))

    # rows whose set another row stands for are not indexed
    again = members.join(nodes.select("node", "one"), "node").where("one.k1 <> k1 or one.k2 <> k2").select("k1", "k2")
    single = join_small(texts, keep(again, "again"), ["k1", "k2"], "left_anti", 32)
    index = single.mapInArrow(_index(k, percent), "sig long, node long, band short, slack int, less boolean, m int, own boolean")
    # both uses of this one shuffle read all columns, so that Spark plans it once
    held = index.repartition(shuffle_partitions(docs.sparkSession), "sig")
    shared = (
        held.groupBy("sig")
        .agg(F.min("node").alias("x"), F.max("node").alias("y"), F.bool_and("less").alias("less"), F.min("band").alias("band"), F.min("slack").alias("slack"), F.min("m").alias("m"), F.bool_or("own").alias("own"), F.count("*").alias("cost"))
        .where("x <> y and not less and band >= 0 and slack >= 0 and m > 0 and own")
        .select("sig", "cost")
    )
    met = keep(held.join(shared.hint("merge"), "sig").distinct(), "met")
    segment = W.partitionBy("node", "band")
    picks = "slack = 0 or rank <= of - slack"
    ranked = keep(
        met.repartition(shuffle_partitions(docs.sparkSession), "node")  # serves both windows and the join
        .withColumn("rank", F.row_number().over(segment.orderBy("cost", "sig")))
        .withColumn("of", F.count("*").over(segment))
        .where("slack = 0 or of > slack")
        .withColumn("weight", F.sum(F.when(F.expr(picks), F.col("cost"))).over(W.partitionBy("node")))
        .join(nodes.select("node", "n"), "node"),
        "ranked",
    )
    groups = ranked.where(picks).drop("cost")

    wanted = keep(groups.select("node").distinct().join(nodes.select("node", "one"), "node").select("node", "one.k1", "one.k2"), "wanted")
    sets = keep(
        join_small(texts, wanted, ["k1", "k2"], "inner", 64)
        .select("node", "bytes")
        .mapInArrow(_packed(k), "node long, shingles binary")
        .dropDuplicates(["node"]),
        "sets",
    )

    first_ones = F.sort_array(F.collect_list(F.when(F.col("rank") <= HEAD, F.struct("rank", "sig"))))["sig"]
    short_name = F.when(F.col("of") <= SHORT_NAMES, (F.col("sig").bitwiseAND(65535) - 32768).cast("short"))
    lists = keep(
        ranked.where("slack > 0").groupBy("node", "band").agg(F.collect_list("sig").alias("sigs"), first_ones.alias("head"), F.collect_set(short_name).alias("names")), "lists"
    )

    def compare(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return keep(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long, linked boolean"), "links")

    def second_side(df: DataFrame, *more: str, blocks: tuple[str, ...] = ()) -> DataFrame:
        names = {"node": "other", **{c: f"{c}2" for c in ("n", "less", "own", *more)}}
        return df.select("sig", *blocks, *(F.col(c).alias(t) for c, t in names.items()))

    def promising(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (node, other, band, slack, need) that have enough segments in common."""
        return (
            pairs.join(lists.select("node", "band", "sigs"), ["node", "band"], "left")
            .join(lists.select("band", F.col("node").alias("other"), F.col("sigs").alias("sigs2")), ["other", "band"], "left")
            .where("slack = 0 or size(array_intersect(sigs, sigs2)) >= need")
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
            .distinct()
        )

    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2) and (own or own2) and not (less and less2)"
    # segments two linked sets have in common at least; all that only one set holds are not
    need = f"m - floor({100 - percent} * (n + n2) / {100 + percent})"
    pair = ["node", "other", "band", "slack", F.expr(need).alias("need")]
    hub = groups.groupBy("sig").agg(F.max_by(F.struct("node", "n", "less", "own"), F.struct("weight", "node")).alias("hub")).select("sig", "hub.*")
    first = promising(groups.join(second_side(hub), "sig").where(f"node <> other and {fits}").select(*pair).distinct())
    links = compare(first)
    label = connected_components(links.where("linked"))
    placed = keep(groups.drop("weight").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    split = (
        placed.groupBy("sig")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .where("x <> y")
        .select("sig", "blocks")
    )
    rest = keep(placed.join(split, "sig").join(lists.select("node", "band", "head", "names"), ["node", "band"], "left"), "rest")
    # both sets order their segments alike, so what they have in common from their first meeting on is all
    # they have; later meetings go where a head, of bounded length, shows an earlier one
    meets = f"1 + least(of - rank, of2 - rank2) >= {need} and not arrays_overlap(slice(head, 1, least(rank - 1, {HEAD})), head2)"
    # equal segments have equal short names, of which a set has of - size(names) fewer than segments
    may_share = f"(size(names) = 0 or size(names2) = 0 or size(array_intersect(names, names2)) + of - size(names) >= {need})"
    second = promising(
        _dealt(rest, "i", "j")
        .join(second_side(_dealt(rest, "j", "i"), "component", "rank", "of", "head", "names", blocks=("i", "j")), ["sig", "i", "j"])
        .where(f"node < other and component <> component2 and {fits} and (slack = 0 or {meets} and {may_share})")
        .select(*pair)
        .distinct()
    ).join(links.select("a", "b"), ["a", "b"], "left_anti")
    return members, links.union(compare(second))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, itself included.  Texts that
    are null or hold no word have no shingles and are linked with nothing; a text of
    fewer than k words is one shingle; equal and repeated rows are linked; a null doc_id
    takes part and is never the smallest; a similarity that ties with the limit is a link; a
    very long text is one set like others, cut into slices on the way; an empty table gives no
    rows; other columns of docs are not read.
    """
    members, links = similar_sets(docs, k, percent)
    label = connected_components(links.where("linked").select("a", "b"))
    worded = members.where("n > 0").join(label, "node", "left").select("k1", "n", F.coalesce("component", "node").alias("class"))
    least = keep(worded.groupBy("class").agg(F.min(doc_id_of()).alias("component_id")), "least")
    # a table on this side, so that a class of very many rows is split in the join
    linked = worded.join(least, "class").select(doc_id_of().alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return linked.union(members.where("n = 0").select(doc_id_of().alias("doc_id"), F.col("n"), doc_id_of().alias("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest doc_id's (of rows that
    agree in doc_id and text any one).  Rows without words and columns stay as they are; an
    empty table stays empty; a very long text is one set like others."""
    members, links = similar_sets(docs, k, percent)
    label = connected_components(links.where("linked").select("a", "b"))
    rows = members.where("n > 0").join(label, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class"))
    order = F.struct((F.col("k1") == -(1 << 63)).alias("no_id"), "k1", "k2")
    best = keep(rows.groupBy("class").agg(F.min(order).alias("best"), F.count("*").alias("copies")).where("copies > 1"), "best")
    first = rows.join(best, "class")
    stays = (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    keyed, key = with_fresh_key(docs)
    gone = keep(first.where(~stays).select("k1", "k2").distinct().toDF(*key), "gone")
    rest = join_small(keyed, gone, key, "left_anti", 32)
    again = keep(first.where(stays).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2").toDF(*key), "again")
    if not again.limit(1).count():
        return rest.select(*docs.columns)
    repeated = join_small(rest, again, key, "left_semi", 32).dropDuplicates(key)
    return join_small(rest, again, key, "left_anti", 32).union(repeated).select(*docs.columns)
