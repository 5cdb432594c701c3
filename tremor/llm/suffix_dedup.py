"""Removal of bytes covered by long strings that occur more than once in a corpus.

Prefix doubling over sampled positions.  A position's rank stands for the string of some
length that begins there; Spark sorts pairs (rank so far, name at a greater length), equal
pairs get one new rank, and what is alone in its pair drops out, until the length is the
threshold.

1. Names of any range of one text follow from prefix sums, so the first ranks, of
   `threshold / 2` bytes, need no shuffle of shorter ones.  Each window of `threshold` bytes
   is represented by the leftmost smallest name inside it; equal windows have equal
   representatives at equal offsets.  Neighbouring windows with one representative form an
   interval (about 100 windows at 400 bytes).
2. First ranking: representatives that occur once drop out with their intervals.
3. Intervals whose bytes are equal throughout repeat together; one of each kind goes on.
4. Growing lengths (3/4, 7/8, 15/16 of the threshold): the windows of the kinds left are cut
   finer by representatives of the greater length.  Pairs (rank, name at that length) are
   sorted and ranked anew, and those met once drop out.  Equal pieces settle as in 3.
5. The threshold itself: every window start of the pieces left becomes a row with the names
   of its two halves; equal pairs are repeats.

Every sort is of distinct pairs, counted before they are shuffled, so a passage that a third
of all texts share is no larger key than any other.  What decides has 128 bits (two
independent fingerprints of the bytes, or the names of both halves); 64-bit names only
bring candidates together.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import SLICE, Ranges, binary, slices
from .common import doc_id_of, forget, keep, numbered, with_row_key

_I = np.int64
#: Low bits of a name that its position takes; a slice and one threshold fit in it at every size.
_PLACE_BITS = np.uint64(20)
_MOST = 1 << 19
#: Bytes of texts whose spans are Python objects at once, and of which one batch goes back.
_PART = 1 << 20


def _argmin_windows(value: np.ndarray, w: int) -> np.ndarray:
    """For each full window of w values the position of its leftmost smallest one.

    Block minima from both ends (two running minima), on values whose low bits are
    replaced by the position: the choice depends on what is in the window only.
    """
    n = len(value)
    key = (value >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(_I)


def _runs(data: np.ndarray, at: np.ndarray, length: int, steps: list[int]) -> Iterator[tuple]:
    """Runs of window starts with one representative of each length in `steps`: row, first and
    last start in the row, the representatives' names, two fingerprints of all the run's bytes."""
    for i, j in slices(at):
        for lo in range(int(at[i]), max(int(at[i]) + 1, int(at[j])), SLICE) if j == i + 1 else [int(at[i])]:
            hi = min(lo + SLICE + length - 1, int(at[j])) if j == i + 1 else int(at[j])
            if hi - lo < length:
                continue
            r, n = Ranges(data[lo:hi]), hi - lo - length + 1
            row = np.minimum(np.searchsorted(at[i + 1 : j + 1] - lo, np.arange(n), side="right"), j - i - 1)  # the row of each start
            inside = np.arange(n) + length <= (at[i + 1 : j + 1] - lo)[row]
            change = np.ones(n, bool)
            change[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
            best = []
            for step in steps:
                p = np.arange(hi - lo - step + 1)
                best.append(_argmin_windows(r.of(p, p + step), length - step + 1))
                change[1:] |= best[-1][1:] != best[-1][:-1]
            s = np.flatnonzero(change)
            e = np.append(s[1:], n) - 1
            s, e = s[inside[s]], e[inside[s]]
            names = [r.of(b[s], b[s] + step).view(_I) for b, step in zip(best, steps, strict=True)]
            whole = [x.of(s, e + length).view(_I) for x in (r, Ranges(data[lo:hi], 1))]
            yield i + row[s], s + lo - at[i + row[s]], e + lo - at[i + row[s]], names, whole


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)


def _find(length: int):
    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for row, lo, hi, (name,), (w1, w2) in _runs(data, at, length, [length // 2]):
                yield _batch(["name", "w1", "w2", "k1", "k2", "lo", "hi"], [name, w1, w2, k1[row], k2[row], lo.astype(_I), hi.astype(_I)])

    return run


_CONTEXT = ["name", "w1", "w2", "copies", "k1", "k2", "lo", "context"]


def _contexts(length: int):
    """One row for each given interval, with all bytes of its windows."""

    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            k1, k2 = b.column("k1").to_pylist(), b.column("k2").to_pylist()
            for i, j in slices(at, _PART):
                out = []
                for n, spans in enumerate(b.column("spans").slice(i, j - i).to_pylist(), i):
                    start = int(at[n])
                    out += [(s["name"], s["w1"], s["w2"], s["copies"], k1[n], k2[n], s["lo"], data[start + s["lo"] : start + s["hi"] + length].tobytes()) for s in spans]
                if out:
                    yield _batch(_CONTEXT, list(zip(*out, strict=True)))

    return run


def _pieces(length: int, steps: list[int]):
    """The windows of each context, cut where the representative of any greater length changes."""

    def run(batches):
        for b in batches:
            data, at = binary(b.column("context"))
            key = {c: b.column(c).to_numpy() for c in ("name", "w1", "w2", "copies")}
            for row, first, last, names, (v1, v2) in _runs(data, at, length, steps):
                columns = {c: x[row] for c, x in key.items()} | {"first": first.astype(_I), "last": last.astype(_I), "v1": v1, "v2": v2}
                columns |= {f"step{k}": x for k, x in enumerate(names)}
                yield _batch(list(columns), list(columns.values()))

    return run


def _positions(length: int):
    """A row for each window start of the pieces of a context, with the names of its two halves."""
    half = length // 2

    def run(batches):
        for b in batches:
            data, at = binary(b.column("context"))
            pieces = b.column("pieces").to_pylist()
            k1, k2, lo = (b.column(c).to_numpy() for c in ("k1", "k2", "lo"))
            for i, j in slices(at):
                r = Ranges(data[at[i] : at[j]])
                mine = [(n, x) for n in range(i, j) for x in pieces[n]]
                size = np.array([x["last"] - x["first"] + 1 for _, x in mine])
                row = np.repeat([n for n, _ in mine], size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat([x["first"] for _, x in mine], size)
                p = at[row] - at[i] + place
                yield _batch(
                    ["rank", "head", "tail", "copies", "k1", "k2", "pos"],
                    [
                        np.repeat(np.array([x["rank"] for _, x in mine], _I), size),
                        r.of(p, p + half).view(_I),
                        r.of(p + half, p + length).view(_I),
                        np.repeat(np.array([x["copies"] for _, x in mine], _I), size),
                        k1[row],
                        k2[row],
                        lo[row] + place,
                    ],
                )

    return run


def _regroup(batches, rows: int = 1 << 16):
    """Arrow batches of a useful size from many small ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rerank(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose pair (rank, name) another row shares, with the pair's place in sorted order as the new rank."""
    met = rows.groupBy("rank", name).count().where("count > 1").select("rank", name)
    places = numbered(met.select(F.col("rank").alias("old"), F.col(name).alias("longer")), "old", "longer")
    again = rows.join(places.withColumnRenamed("rank", "new"), (F.col("rank") == F.col("old")) & (F.col(name) == F.col("longer")))
    return keep(again.drop("rank", "old", "longer", name).withColumnRenamed("new", "rank"), "ranked")


def _settle(rows: DataFrame, key: list[str], copies) -> DataFrame:
    """One row for each key (equal bytes) with the number of its copies; `one` is a row of it."""
    return rows.groupBy(*key).agg(copies.alias("copies"), F.min(F.struct(*(c for c in rows.columns if c not in key))).alias("one"))


def repeated_windows(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """(k1, k2, lo, hi): the window starts lo..hi of a text (k1, k2) whose `threshold` bytes
    also start somewhere else, in this text or another.  Matches stay inside one text."""
    if not 2 <= threshold <= _MOST:
        raise ValueError(f"threshold must be from 2 to {_MOST}")
    half = threshold // 2
    steps = sorted({x for x in (threshold * 3 // 4, threshold * 7 // 8, threshold * 15 // 16) if half < x < threshold}) or [half]
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", "k2", F.col("text").cast("binary").alias("bytes"))
    find, contexts_of, pieces_of, positions_of = _find(threshold), _contexts(threshold), _pieces(threshold, steps), _positions(threshold)
    found = keep(
        texts.where(F.length("bytes") >= threshold).mapInArrow(
            lambda b: _regroup(find(b)), "name long, w1 long, w2 long, k1 long, k2 long, lo long, hi long"
        ),
        "intervals",
    )
    repeated = keep(found.groupBy("name").count().where("count > 1").select("name"), "repeated")  # as a table, so that skewed names are split in the join
    shared = keep(found.join(repeated, "name"), "shared")
    forget(found)
    kinds = keep(_settle(shared, ["name", "w1", "w2"], F.count("*")), "kinds")
    equal = keep(shared.join(kinds.where("copies > 1").select("name", "w1", "w2"), ["name", "w1", "w2"]).select("k1", "k2", "lo", "hi"), "equal")
    forget(shared)

    mixed = keep(kinds.groupBy("name").count().where("count > 1").select("name"), "mixed")
    span = F.struct("name", "w1", "w2", "copies", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))
    open_ = kinds.join(mixed, "name").select("one.k1", "one.k2", span.alias("span")).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    contexts = keep(
        texts.join(keep(open_, "open").hint("merge"), ["k1", "k2"])  # about every second text has some
        .select("k1", "k2", "bytes", "spans")
        .mapInArrow(contexts_of, "name long, w1 long, w2 long, copies long, k1 long, k2 long, lo long, context binary"),
        "contexts",
    )
    names = ", ".join(f"step{k} long" for k in range(len(steps)))
    rows = contexts.mapInArrow(
        lambda b: _regroup(pieces_of(b)), f"name long, w1 long, w2 long, copies long, first long, last long, v1 long, v2 long, {names}"
    ).withColumn("rank", F.col("name"))
    for k in range(len(steps)):
        shorter, rows = rows, _rerank(rows, f"step{k}")
        if k:
            forget(shorter)
    home = ["name", "w1", "w2"]
    pieces = keep(_settle(rows, ["rank", "v1", "v2"], F.sum("copies")), "pieces")
    alike = pieces.where("copies > 1").select("rank", "v1", "v2")
    open_piece = pieces.join(pieces.groupBy("rank").count().where("count > 1").select("rank"), "rank")
    place = F.struct("rank", F.col("one.first").alias("first"), F.col("one.last").alias("last"), F.col("copies").cast("long").alias("copies"))
    at_home = open_piece.select(*(f"one.{c}" for c in home), place.alias("piece")).groupBy(*home).agg(F.collect_set("piece").alias("pieces"))
    positions = keep(
        contexts.select(*home, "k1", "k2", "lo", "context")
        .join(at_home, home)
        .mapInArrow(positions_of, "rank long, head long, tail long, copies long, k1 long, k2 long, pos long"),
        "positions",
    )
    again = positions.groupBy("rank", "head", "tail").agg(F.sum("copies").alias("met")).where("met > 1").drop("met")
    late = positions.where("copies = 1").join(again, ["rank", "head", "tail"]).select("k1", "k2", F.col("pos").alias("lo"), F.col("pos").alias("hi"))
    settled = (
        rows.where("copies = 1")  # of intervals met more than once, every copy is in `equal`
        .join(alike, ["rank", "v1", "v2"])
        .select(*home, "first", "last")
        .join(contexts.select(*home, "k1", "k2", F.col("lo").alias("base")), home)
        .select("k1", "k2", (F.col("base") + F.col("first")).alias("lo"), (F.col("base") + F.col("last")).alias("hi"))
    )
    return equal.union(settled).union(late)


def _cut(length: int):
    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            for i, j in slices(at, _PART):
                out = []
                for n, spans in enumerate(b.column("spans").slice(i, j - i).to_pylist(), i):
                    text = data[at[n] : at[n + 1]]
                    mark = np.zeros(len(text) + 1, dtype=np.int32)
                    if spans:
                        np.add.at(mark, [s["lo"] for s in spans], 1)
                        np.add.at(mark, [s["hi"] + length for s in spans], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                    out.append((int(gone.sum()), runs, text[~gone].tobytes() if runs else text.tobytes()))
                removed, runs, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k1").slice(i, j - i), pa.array(np.diff(at[i : j + 1])), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    ["k1", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and kept (binary, the remaining bytes).

    A null text is empty; an empty or shorter text keeps all; a very long text is read in
    slices that overlap by the threshold, with the same result; a null doc_id stays null;
    repeated rows remove each other's windows like any two equal texts; an empty table
    gives no rows; other columns of docs are not read; ties cannot matter, as every one of
    equal strings goes.  `kept` can end inside a UTF-8
    character, as strings are judged by bytes.
    """
    starts = repeated_windows(docs, threshold)
    spans = keep(
        starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")),
        "spans",
    )
    texts = with_row_key(docs.select("doc_id", "text")).select(
        "k1", "k2", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes")
    )
    joined = texts.join(spans.hint("merge"), ["k1", "k2"], "left")
    out = joined.select("k1", "bytes", "spans").mapInArrow(
        _cut(threshold), "k1 long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.select(doc_id_of().alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
