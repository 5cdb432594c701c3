"""Mixing sources to target weights by balanced sampling (the cube method).

A text of a source whose target is f times its size is taken floor(f) times, and once
more with probability f - floor(f).  Which texts get the extra copy is drawn by the
cube method: probabilities move inside the null space of two constraints, the source's
word total and its number of texts, until all but two are 0 or 1.  A source is dealt to
blocks of BLOCK texts; each block's flight runs by itself and passes its two open texts
on, and levels repeat until a source is one block.  There the landing drops the count
constraint, then draws the last text.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, keep, numbered

#: Texts in one flight.
BLOCK = 2_000
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def _move(active: list[list[float]], direction: list[float], rng: random.Random) -> None:
    """Move the active probabilities along a null vector, up or down, to the nearest face."""
    up = min((1 - a[1]) / u if u > 0 else a[1] / -u for a, u in zip(active, direction, strict=True) if u)
    down = min(a[1] / u if u > 0 else (1 - a[1]) / -u for a, u in zip(active, direction, strict=True) if u)
    step = up if rng.random() * (up + down) < down else -down
    for a, u in zip(active, direction, strict=True):
        p = a[1] + step * u
        a[1] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def flight(size: list[int], pi: list[float], rng: random.Random, land: bool) -> list[float]:
    """Probabilities after the flight, at most two of them open; none if the landing is wanted."""
    done = list(pi)
    active: list[list[float]] = []  # size, probability, place

    def settle():
        for a in active:
            done[a[2]] = a[1]
        active[:] = [a for a in active if 0 < a[1] < 1]

    for place, (s, p) in enumerate(zip(size, pi, strict=True)):
        if not _EPS < p < 1 - _EPS:
            done[place] = float(round(p))
            continue
        active.append([float(s), p, place])
        while len(active) == 3:
            a, b, c = (x[0] for x in active)
            direction = [b - c, c - a, a - b]
            _move(active, direction if any(direction) else [1.0, -1.0, 0.0], rng)
            settle()
    if land:
        while active:
            if len(active) == 2:
                a, b = active[0][0], active[1][0]
                _move(active, [b, -a], rng)
            else:
                active[0][1] = float(rng.random() < active[0][1])
            settle()
    return done


def _block(land: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        rng = random.Random(f"{seed}:{int(pdf['key'].iloc[0])}:{len(pdf)}")
        return pdf.assign(pi=flight(pdf["size"].tolist(), pdf["pi"].tolist(), rng, land))

    return run


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n) -> with target.

    Sources in code point order, null last, weigh weights[0], weights[1], .. repeating and
    share the total; a target stops at cap times its source and the excess is shared again.
    """
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = keep(numbered(sources, F.col("source").asc_nulls_last()).withColumn("w", weigh).withColumn("most", F.col("source_size") * cap), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level only rises, so each source is capped once at most
        full = F.col("w") * level > F.col("most")
        n, above, weight = weighed.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        ).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - above) / weight
    return weighed.select("source", "source_size", "n", F.least(F.col("w") * level, F.col("most")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3, seed: int = 0) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, size, source_size,
    target, copies, taken.

    size is the number of words; a null or empty text has size 0 and 0 copies; a null source
    is a source; ties of size go by a hash of the row; repeated rows are drawn one by one;
    a very long text is one size like others; an empty table gives no rows; other columns of docs are not read.  Reruns agree, as all
    draws are seeded by the rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = keep(docs.select("doc_id", "source", size.alias("size")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(keep(sources, "sources"), weights, float(cap))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = F.col("sizes.source").eqNullSafe(F.col("aimed.source"))
    rows = (
        sizes.alias("sizes")
        .join(aimed.alias("aimed"), of)
        .select("doc_id", F.col("sizes.source").alias("source"), "size", "source_size", "target", "n", F.least(share, F.lit(float(cap))).alias("share"))
        .withColumn("base", F.when(F.col("size") > 0, F.floor("share")).otherwise(0))
        .withColumn("pi", F.when(F.col("size") > 0, F.col("share") - F.floor("share")).otherwise(0.0))
        .withColumn("key", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .drop("n", "share")
    )
    settled = []
    while True:
        blocked = rows.withColumn("block", F.pmod("key", "blocks"))
        one = keep(rows.groupBy("source").agg(F.max("blocks").alias("blocks")), "blocks").agg(F.max("blocks")).first()[0] or 1
        flown = keep(
            blocked.groupBy("source", "block").applyInPandas(_block(one == 1, seed), blocked.schema).drop("block"), "flown"
        )
        if one == 1:
            settled.append(flown)
            break
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(flown.where(~open_))
        rows = flown.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    copies = (F.col("base") + F.col("pi")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3, seed: int = 0) -> DataFrame:
    """docs with each row as often as mix_sources takes it; columns as they are.

    Rows are matched by doc_id, source and size (words).  Rows that agree in all three have
    one share; where their copies do not divide evenly, the rows are numbered and the first
    ones get one more, so the copies are exactly those of the mix.  Nulls match nulls; texts
    without words go, as the mix takes none of them; a very long text is one row like others;
    an empty table stays empty; columns of any name are kept.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rank, words, copies, rows, uid, doc_id, source, of = fresh(docs.columns, "rank", "words", "copies", "rows", "uid", "id_of", "source_of", "size_of")
    mixed = mix_sources(docs, weights, cap, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    taken = keep(mixed.where(F.col(copies) > 0).select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("size").alias(of), copies, rows), "taken")
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(of))

    def meet(some: DataFrame) -> DataFrame:
        small = F.broadcast(some) if some.count() * 64 <= BROADCAST_BYTES else some
        return docs.withColumn(words, size).join(small, same)

    def repeat(found: DataFrame, times) -> DataFrame:
        return found.withColumn(uid, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)

    each, left = F.floor(F.col(copies) / F.col(rows)), F.col(copies) % F.col(rows)
    out = repeat(meet(taken.where(left == 0)), each)
    odd = taken.where(left > 0)
    if not odd.limit(1).count():
        return out
    tied = keep(meet(odd).withColumn(uid, F.monotonically_increasing_id()), "tied")  # written, so ids do not change
    ranked = keep(numbered(tied, doc_id, source, of, uid, name=rank), "tied")
    a, b, c, least = fresh(ranked.columns, "tie_id", "tie_source", "tie_size", "least")
    first = keep(ranked.groupBy(doc_id, source, of).agg(F.min(rank).alias(least)).toDF(a, b, c, least), "first")
    turned = ranked.join(first, F.col(doc_id).eqNullSafe(F.col(a)) & F.col(source).eqNullSafe(F.col(b)) & (F.col(of) == F.col(c)))
    return out.union(repeat(turned, each + (F.col(rank) - F.col(least) < left).cast("long")))
