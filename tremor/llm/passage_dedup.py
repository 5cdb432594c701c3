"""Removal of passages that an earlier document holds already, by windows of words.

1. Every window of `length` neighbouring words of every text gets a Rabin-Karp hash, rolled
   over the words' fingerprints.  Inside an Arrow batch, of the documents that hold a window
   only the one of the smallest id has to ask about it; for the others the answer is known,
   so a passage that a third of all texts share is one question a batch, not one a text.
2. Spark deals the questions, two longs each, by hash and compares each with the smallest
   document that holds the same window.  The later documents get their hashes back.
3. Texts that got some roll their windows again; windows found in an earlier document merge
   into maximal runs of words, which go.

Windows are equal when their 64-bit hashes are: among 7 * 10^9 windows (30 GB of text) about
one pair of different ones is expected to share a hash.  Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bytehash import _SPACE, _bounds, binary, slices, window_hashes, words
from .common import doc_id_of, keep, with_row_key

U, _I = np.uint64, np.int64


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs i..j of rows: i, j, the hashes of their windows, n + 1 offsets into these."""
    for i, j, h, offset in words(data, at, fold=False):
        many = np.maximum(0, np.diff(offset) - length + 1)
        end = np.concatenate(([0], np.cumsum(many)))
        of = np.repeat(offset[:-1] - end[:-1], many) + np.arange(end[-1])
        yield i, j, (window_hashes(h, length)[of] if len(of) else np.zeros(0, U)), end


def _questions(length: int):
    """h, k1, known: a row for each different window of a batch with the smallest document that
    holds it; and for every larger document of the batch a row with known, the window's hash
    (its h is of the document, as nobody has to compare it)."""

    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            k1 = b.column("k1").to_numpy()
            hashes, rows = [np.zeros(0, U)], [np.zeros(0, _I)]
            for i, j, h, end in _windows(data, at, length):
                hashes.append(h)
                rows.append(np.repeat(np.arange(i, j), np.diff(end)))
            h, row = np.concatenate(hashes), np.concatenate(rows)
            rank = np.unique(k1, return_inverse=True)[1][row]  # of the row's id among the batch's
            if np.any(rank[1:] < rank[:-1]):
                by_id = np.argsort(rank, kind="stable")
                h, row, rank = h[by_id], row[by_id], rank[by_id]
            order = np.argsort(h, kind="stable")
            new, later = np.ones(len(h), bool), np.zeros(len(h), bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            if len(h):
                first = rank[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
                later = (rank[order] > first) & (new | np.concatenate(([True], rank[order[1:]] != rank[order[:-1]])))
            asks, knows = np.sort(order[new]), np.sort(order[later])  # document by document, which compresses well
            known = pa.array(np.concatenate((np.zeros(len(asks), _I), h[knows].view(_I))), mask=np.arange(len(asks) + len(knows)) < len(asks))
            ids = k1[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((h[asks].view(_I), ids[knows]))), pa.array(np.concatenate((ids[asks], ids[knows]))), known], ["h", "k1", "known"]
            )

    return run


def repeated_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """k1, h: the hashes of windows of docs (doc_id, text) that also start in a document of a smaller id."""
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", F.col("text").cast("binary").alias("bytes"))
    asked = texts.where(F.length("bytes") >= 2 * length - 1).mapInArrow(_questions(length), "h long, k1 long, known long")
    # dealt before the window, which would otherwise add a column to what travels
    asked = asked.repartition("h")
    same = W.partitionBy("h").orderBy("k1").rowsBetween(W.unboundedPreceding, 0)
    first = F.min(F.when(F.col("known").isNull(), F.col("k1"))).over(same)
    return asked.withColumn("first", first).where("known is not null or first < k1").select("k1", F.coalesce("known", "h").alias("h"))


def _cut(length: int):
    """Words, removed words and the rest of each text."""

    def run(batches):
        for b in batches:
            data, at = binary(b.column("bytes"))
            answers = b.column("answers")
            place = np.concatenate(([0], np.cumsum(answers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(_I)
            flat = answers.flatten().to_numpy(zero_copy_only=False).view(U)
            told = np.flatnonzero(np.diff(place))
            n_words, n_removed, kept = [np.zeros(0, _I)], [np.zeros(0, _I)], []
            for i, j in slices(at):
                buf, row_at = data[at[i] : at[j]], at[i : j + 1] - at[i]
                s, e = _bounds(buf, row_at)
                word_at = np.searchsorted(s, row_at)
                n = np.diff(word_at)
                gone = np.zeros(len(s), bool)
                mine = told[np.searchsorted(told, i) : np.searchsorted(told, j)]
                if len(mine):
                    mark = np.zeros(len(s) + 1, np.int32)
                    for a, _, h, end in _windows(buf, row_at, length):
                        for r in mine[np.searchsorted(mine, i + a) : np.searchsorted(mine, i + a + len(end) - 1)]:
                            found = word_at[r - i] + np.flatnonzero(np.isin(h[end[r - i - a] : end[r - i - a + 1]], flat[place[r] : place[r + 1]]))
                            mark[found] += 1
                            mark[found + length] -= 1
                    gone = np.cumsum(mark[:-1]) > 0
                n_words.append(n)
                n_removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[word_at]))
                # a word that stays takes the byte before it along as its space, if its row has one
                lead = s - (s > np.repeat(row_at[:-1], n))
                edge = np.zeros(len(buf) + 1, np.int32)
                np.add.at(edge, lead[~gone], 1)
                np.add.at(edge, e[~gone], -1)
                stays = np.cumsum(edge[:-1]) > 0
                rest = np.where(_SPACE[buf], np.uint8(32), buf)[stays].tobytes()
                cut = np.concatenate(([0], np.cumsum(stays)))[row_at].tolist()
                kept += [rest[a:c].lstrip(b" ") for a, c in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(kept, pa.binary())],
                ["k1", "n_words", "n_removed", "kept"],
            )

    return run


def remove_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed and kept, the words
    that stay, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+ as they are.  A word goes if a window of `length` words that
    covers it also starts in a document of a smaller doc_id.  A null text has no words; texts
    of fewer words than a window keep all; a very long text is one text, rolled in slices; a
    null doc_id counts as the smallest; rows of one doc_id (ties, repeated rows) do not remove
    each other's words, and get their answers together; an empty table gives no rows; other
    columns of docs are not read.
    """
    if length < 1:
        raise ValueError("a window has one word at least")
    answers = keep(repeated_windows(docs, length).groupBy("k1").agg(F.collect_set("h").alias("answers")), "answers")
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    cut = texts.join(answers.hint("merge"), "k1", "left").select("k1", "bytes", "answers").mapInArrow(
        _cut(length), "k1 long, n_words long, n_removed long, kept binary"
    )
    return cut.select(doc_id_of().alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
