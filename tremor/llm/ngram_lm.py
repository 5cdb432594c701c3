"""An n-gram language model learnt from and applied to whole corpora.

Texts are packed, where they are read, into batches of about BATCH_TOKENS tokens: the
batch's sorted distinct words (63-bit names) and its tokens as places in that list.  The
batches are stored once, bucketed by batch, and never shuffled again.  Counts and
probabilities travel instead of tokens, in three passes for orders 1, 2 and 3: a batch sends
its distinct words, pairs or triples with their training counts to the shards that own
them, a shard adds up what all batches send, and each batch gets back one number for each
thing it sent.  A message holds all that goes from a batch to a shard, so there are never
more messages than distinct n-grams of the batches, and a pass's files are freed before the
next one.

N-grams are owned by context.  A shard builds an Elias-Fano trie of its training n-grams
with quantised relative frequencies, finds each context once and answers for its words by
successor search inside the context's pointer range.  Contexts that would fill more than
HOT_SHARE of a shard are spread by successor, so no context has to fit one task.

P0(w) is the add-one unigram estimate, and with q the stored frequency and c the training
count of the context,

    P2(w | u) = l q(w | u) + (1 - l) P0(w),           l = c(u) / (c(u) + PRIOR)
    P3(w | u v) = l q(w | u v) + (1 - l) P2(w | v),   l = c(u v) / (c(u v) + PRIOR)

The first word of a text follows BEGIN.  Triples met once are not stored, unless asked for, as is usual for
the highest order; so only triples are sent both of whose pairs were met `min_triple` times,
as no other can be.  P2 sums to one up to the quantiser; P3 keeps the mass of successors
met once for words outside the training texts and sums to one at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import binary, mix, words
from .common import ARROW_BYTES, doc_id_of, forget, keep, pack_bytes, settings, shuffle_partitions, unpack_bytes, with_row_key
from .elias_fano import NgramTrie, probability

U = np.uint64
BATCH_TOKENS = 5 << 18
#: A shard gets about so many n-grams, and every shuffle partition has SHARDS_A_PART shards at least.
SHARD_PAIRS = 1 << 20
SHARDS_A_PART = 2
HOT_SHARE = 0.1
PRIOR = 5.0
#: Triples met less often are not stored, unless score_texts is asked for them.
MIN_TRIPLE = 2
END, BEGIN = U(1), U(2)


def _pack(most: int):
    """Batches of whole texts: doc keys, held-out flags, token counts, vocabulary, token places."""

    def run(batches):
        k1, held, count, tokens, total = [], [], [], [], 0
        part, serial = TaskContext.get().partitionId(), 0

        def row():
            names, place = np.unique(np.concatenate(tokens), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + serial]),
                    pa.array([k1]),
                    pa.array([held]),
                    pa.array([count]),
                    pa.array([names.tobytes()]),
                    pa.array([place.astype(np.uint32).tobytes()]),
                ],
                ["batch", "k1", "held", "n", "words", "places"],
            )

        for b in batches:
            data, at = binary(b.column("bytes"))
            ids, flags = b.column("k1").to_pylist(), b.column("held").to_pylist()
            for i, j, h, o in words(data, at):
                ends = np.insert(h >> U(1), o[1:], END)  # one end after each text
                k1 += ids[i:j]
                held += flags[i:j]
                count += (np.diff(o) + 1).tolist()
                tokens.append(ends)
                total += len(ends)
                if total >= most:
                    yield row()
                    k1, held, count, tokens, total, serial = [], [], [], [], 0, serial + 1
        if tokens:
            yield row()

    return run


class _Grams:
    """Distinct n-grams of one order in a batch, in the order of the shards that own them.

    context, word: places of each n-gram's context (in a list of context names) and last word;
    of: the n-gram of each token it belongs to."""

    def __init__(self, key: np.ndarray, names: np.ndarray, totals: np.ndarray, words: np.ndarray, shards: int, limit: float):
        """key: context place * 2^32 + word place of each token; names and totals of the contexts; names of the words."""
        distinct, back = np.unique(key, return_inverse=True)
        context, word = distinct >> 32, distinct & 0xFFFFFFFF
        salt = np.where(totals[context] > limit, mix(words[word] + U(17)), U(0))
        shard = ((mix(names[context] ^ salt) >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.shard, self.context, self.word, self.of = shard[order], context[order], word[order], rank[back]
        self.names, self.totals, self.words = names, totals, words

    def messages(self, batch: int, train: np.ndarray):
        """Rows for the shards, with the training counts; train tells the tokens that count."""
        count = np.bincount(self.of[train], minlength=len(self.word)).astype(np.uint32)
        cut = np.append(_runs(self.shard), len(self.shard))
        for a, e in zip(cut[:-1], cut[1:], strict=True):
            start = _runs(self.context[a:e])
            u = self.context[a:e][start]
            word, number = np.unique(self.word[a:e], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(self.shard[a])]),
                    pa.array([batch]),
                    pa.array([self.names[u].tobytes()]),
                    _packed(self.totals[u]),
                    _packed(np.diff(np.append(start, e - a)).astype(np.uint32)),
                    pa.array([self.words[word].tobytes()]),
                    _packed(number.astype(np.uint32)),
                    _packed(count[a:e]),
                ],
                ["shard", "batch", "contexts", "context_totals", "runs", "words", "numbers", "counts"],
            )


class _Batch:
    """A stored batch, as arrays."""

    def __init__(self, b: pa.RecordBatch, r: int):
        get = lambda name: b.column(name)[r]
        self.batch = get("batch").as_py()
        self.n = np.array(get("n").as_py(), np.int64)
        self.names = np.frombuffer(get("words").as_buffer(), U)
        self.place = np.frombuffer(get("places").as_buffer(), np.uint32).astype(np.int64)
        self.train = np.repeat(~np.array(get("held").as_py(), bool), self.n)
        self.first = np.zeros(len(self.place), bool)
        self.first[np.cumsum(self.n) - self.n] = True

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.place[self.train], minlength=len(self.names))

    def pairs(self, total: np.ndarray, shards: int, limit: float) -> _Grams:
        """total: training counts of the batch's words over the corpus.  Contexts are places in
        the vocabulary; the place after the last is the begin of a text, as frequent as its end."""
        before = np.empty_like(self.place)
        before[1:] = self.place[:-1]
        before[self.first] = len(self.names)
        totals = np.append(total, total[np.searchsorted(self.names, END)])
        return _Grams(before << 32 | self.place, np.append(self.names, BEGIN), totals, self.names, shards, limit)

    def triples(self, pairs: _Grams, counts: np.ndarray, shards: int, limit: float, least: int) -> tuple[np.ndarray, _Grams]:
        """Tokens whose triple may be stored, and the triples; counts: training counts of the pairs over the corpus."""
        often = (counts >= least)[pairs.of]
        at = np.flatnonzero(~self.first[1:] & often[1:] & often[:-1]) + 1
        name = mix(pairs.names[pairs.context] + mix(self.names[pairs.word] + U(3))) >> U(1)
        return at, _Grams(pairs.of[at - 1] << 32 | self.place[at], name, counts, self.names, shards, limit)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([pack_bytes(x.tobytes())])


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(unpack_bytes(x), kind)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _send_words(shards: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = _Batch(b, r)
                count = x.word_counts()
                cut = np.searchsorted(x.names, np.array([(s << 63) // shards for s in range(1, shards)], U))
                cut = np.concatenate(([0], cut, [len(x.names)]))
                for s in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[s], cut[s + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s]), pa.array([x.batch]), pa.array([x.names[part].tobytes()]), pa.array([count[part].astype(np.uint32).tobytes()])],
                        ["shard", "batch", "words", "counts"],
                    )

    return run


def _add_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one shard's words, sent back to every batch that asked; batch -1: n and v of the shard."""
    name = np.concatenate([np.frombuffer(x, U) for x in pdf["words"]])
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]])
    distinct, back = np.unique(name, return_inverse=True)
    total = np.bincount(back, count, minlength=len(distinct))
    cut = np.cumsum([len(x) // 8 for x in pdf["words"]])[:-1]
    answers = [pack_bytes(x.astype(np.int64).tobytes()) for x in np.split(total[back], cut)]
    out = pd.DataFrame({"shard": pdf["shard"], "batch": pdf["batch"], "totals": answers, "n": 0, "v": 0})
    out.loc[len(out)] = [int(pdf["shard"].iloc[0]), -1, b"", int(total.sum()), int((total > 0).sum())]
    return out


def _joined(b: pa.RecordBatch, r: int, column: str, field: str, kind) -> np.ndarray:
    """What all shards answered, in the order of the shards; nothing was asked where there is no answer."""
    found = sorted(b.column(column)[r].as_py() or [], key=lambda x: x["shard"])
    return np.concatenate([np.zeros(0, kind), *(_unpacked(x[field], kind) for x in found)])


def _send_pairs(shards: int, limit: float):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = _Batch(b, r)
                total = _joined(b, r, "word_answers", "totals", np.int64)
                yield from x.pairs(total, shards, limit).messages(x.batch, x.train)

    return run


def _send_triples(shards: int, limit: float, least: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = _Batch(b, r)
                total = _joined(b, r, "word_answers", "totals", np.int64)
                counts = _joined(b, r, "pair_answers", "counts", np.uint32).astype(np.int64)
                at, grams = x.triples(x.pairs(total, shards, limit), counts, shards, limit, least)
                yield from grams.messages(x.batch, x.train[at])

    return run


def _answer(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One shard: a trie of its training n-grams met `least` times, and codes and counts of all that were sent."""
        joined = lambda name, kind: np.concatenate([_unpacked(x, kind) for x in pdf[name]])
        asked, run = np.concatenate([np.frombuffer(x, U) for x in pdf["contexts"]]), joined("runs", np.uint32)
        numbers = [_unpacked(x, np.uint32) for x in pdf["numbers"]]
        successor = np.concatenate([np.frombuffer(w, U)[x] for w, x in zip(pdf["words"], numbers, strict=True)])
        contexts, at, of = np.unique(asked, return_index=True, return_inverse=True)
        names, number = np.unique(successor, return_inverse=True)
        key, back = np.unique(np.repeat(of, run).astype(U) << U(32) | number.astype(U), return_inverse=True)
        count = np.bincount(back, joined("counts", np.uint32), minlength=len(key)).astype(np.uint32)
        seen = np.flatnonzero(count >= least)
        ix, word = (key[seen] >> U(32)).astype(np.int64), names[(key[seen] & U(0xFFFFFFFF)).astype(np.int64)]
        trie = NgramTrie(contexts, joined("context_totals", np.int64)[at], ix, word, count[seen])
        code = trie.lookup(asked, run, successor)
        cut = np.cumsum([len(x) for x in numbers])[:-1]
        out = pd.DataFrame({"shard": pdf["shard"], "batch": pdf["batch"], "codes": [pack_bytes(x.tobytes()) for x in np.split(code, cut)]})
        return out.assign(counts=[pack_bytes(x.tobytes()) for x in np.split(count[back], cut)] if least == 1 else None)

    return run


def _score(shards: int, limit: float, n: int, v: int, least: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = _Batch(b, r)
                total = _joined(b, r, "word_answers", "totals", np.int64)
                pairs = x.pairs(total, shards, limit)
                counts = _joined(b, r, "pair_answers", "counts", np.uint32).astype(np.int64)
                at, triples = x.triples(pairs, counts, shards, limit, least)
                unigram = (total + 1.0) / (n + (v + 1.0))
                c = pairs.totals[pairs.context]
                weight = c / (c + PRIOR)
                p = (weight * probability(_joined(b, r, "pair_answers", "codes", np.uint8)) + (1 - weight) * unigram[pairs.word])[pairs.of]
                before = np.zeros(len(p))  # training count of the two words before
                before[1:] = np.where(x.first[1:], 0, counts[pairs.of[:-1]])
                q = np.zeros(len(p))
                q[at] = probability(_joined(b, r, "triple_answers", "codes", np.uint8))[triples.of]
                weight = before / (before + PRIOR)
                p = weight * q + (1 - weight) * p
                at = np.cumsum(x.n) - x.n
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("k1")[r].values,
                        b.column("held")[r].values,
                        pa.array(x.n),
                        pa.array(np.add.reduceat((total > 0)[x.place].astype(np.int64), at)),
                        pa.array(np.full(len(at), n)),
                        pa.array(np.add.reduceat(np.log10(unigram)[x.place], at)),
                        pa.array(np.add.reduceat(np.log10(p), at)),
                    ],
                    ["k1", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2, min_triple: int = MIN_TRIPLE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) modulo folds is held_fold are scored only; all others
    are learnt from, too.  Triples met min_triple times are stored; at 1 nothing is left out.  A null text is empty and has one token, its end; a very long text
    is one batch; a null doc_id is learnt from; repeated rows count each time, and rows that tie
    in doc_id are texts of their own; without
    training texts every word is unknown and N is 0; an empty table gives no rows; other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    message = "shard long, batch long, contexts binary, context_totals binary, runs binary, words binary, numbers binary, counts binary"
    answer = "shard long, batch long, codes binary, counts binary"
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", held.alias("held"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    table = f"tremor_lm_{uuid.uuid4().hex}"
    with settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=ARROW_BYTES):
        texts.mapInArrow(
            _pack(BATCH_TOKENS), "batch long, k1 array<long>, held array<boolean>, n array<long>, words binary, places binary"
        ).write.bucketBy(shuffle_partitions(spark), "batch").option("compression", "zstd").saveAsTable(table)

    def back(answers: DataFrame, name: str, *fields: str) -> DataFrame:
        """All answers of a batch in one row."""
        return answers.groupBy("batch").agg(F.collect_list(F.struct("shard", *fields)).alias(name)).hint("merge")

    def asked(messages: DataFrame, least: int, name: str) -> DataFrame:
        return keep(messages.groupBy("shard").applyInPandas(_answer(least), answer), name)

    try:
        stored = spark.table(table)
        n_batches = stored.count()
        if not n_batches:
            return spark.createDataFrame([], schema)
        shards = max(SHARDS_A_PART * shuffle_partitions(spark), n_batches * BATCH_TOKENS // SHARD_PAIRS)
        words_ = keep(
            stored.mapInArrow(_send_words(shards), "shard long, batch long, words binary, counts binary")
            .groupBy("shard")
            .applyInPandas(_add_words, "shard long, batch long, totals binary, n long, v long"),
            "words",
        )
        n, v = words_.where("batch = -1").agg(F.sum("n"), F.sum("v")).first()
        limit = max(1.0, HOT_SHARE * n / shards)
        known = stored.join(back(words_.where("batch >= 0"), "word_answers", "totals"), "batch")
        pairs = asked(known.mapInArrow(_send_pairs(shards, limit), message), 1, "pairs")
        counted = known.join(back(pairs, "pair_answers", "counts"), "batch")
        triples = asked(counted.mapInArrow(_send_triples(shards, limit, min_triple), message), min_triple, "triples")
        known = known.join(back(pairs, "pair_answers", "codes", "counts"), "batch").join(back(triples, "triple_answers", "codes"), "batch", "left")
        scored = keep(
            known.mapInArrow(
                _score(shards, limit, n, v, min_triple),
                "k1 long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
            ),
            "scores",
        )
        forget(words_, pairs, triples)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return scored.select(doc_id_of().alias("doc_id"), *scored.columns[1:])
