"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, fine or nothing on every document.  Expectation-
maximisation estimates each labeller's accuracy without any true label; all documents
take part, as the counts of the vote patterns (at most 3^7) are all it needs.  Documents'
posterior labels then train a linear scorer on hashed features of word shapes, on at most
MAX_TRAIN different documents drawn by a hash; the scorer decides about every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import _LOWER, _SPACE, Ranges, binary, mix, slices
from .common import doc_id_of, join_small, keep, with_fresh_key, with_row_key

U = np.uint64
#: Most documents that train the scorer.
MAX_TRAIN = 8192
#: Hashed features.
DIM = 1024
#: A document is rejected when its score is at least this.
REJECT = 0.5
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is a that it for with as was on are by this be from or an at he "
    "la le de et les des que un une du pour dans par qui est der die das und von den zu ist mit im dem ein eine nicht "
    "el los las y en del se por con para su al es no"
).split()
ABSTAIN, FINE, JUNK = 0, 1, 2
#: Labeller: measure, words a text must have, junk below, fine from, fine to, junk above.
LABELLERS = (
    ("symbols", 5, None, None, 0.02, 0.10),
    ("capitals", 5, None, None, 0.05, 0.30),
    ("tables", 5, None, None, 0.01, 0.08),
    ("repeats", 15, None, None, 0.05, 0.15),
    ("stop_words", 30, 0.10, 0.18, None, None),
    ("distinct", 60, 0.35, 0.50, None, None),
    ("letters", 5, 0.86, 0.93, None, None),
)
_KIND = np.zeros(256, np.uint8)  # 0 letter above ASCII or below it, 1 capital, 2 small, 3 digit, 4 stop mark, 5 symbol
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def _word_list() -> np.ndarray:
    buf = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    e = np.append(np.flatnonzero(buf == 32), len(buf))
    s = np.concatenate(([0], e[:-1] + 1))
    return np.unique(Ranges(buf).of(s, e))


def measure(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, the labellers' measures, and (row of each word, shape code of each word) of a slice."""
    n_rows = len(rows) - 1
    word = ~_SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = rows[(rows > 0) & (rows < len(buf))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(s, rows)
    n = np.diff(at)
    of = np.repeat(np.arange(n_rows), n)
    kind = _KIND[buf]

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[e] - total[s]

    small, capital, symbol = inside((kind == 2) | (kind == 0) & word), inside(kind == 1), inside(kind == 5)
    length = e - s
    tail = np.where(length > 0, kind[e - 1], 0)
    name = Ranges(_LOWER[buf]).of(s, e) if len(s) else np.zeros(0, U)
    repeat = np.zeros(len(s), bool)
    repeat[1:] = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
    bar = (length == 1) & (buf[s] == ord("|"))
    core = np.where((tail == 4) & (length > 1), 1, 0)
    stop = np.isin(name, _STOP) | np.isin(Ranges(_LOWER[buf]).of(s, e - core), _STOP) if len(s) else np.zeros(0, bool)
    share = lambda flag: np.bincount(of, flag, minlength=n_rows) / np.maximum(1, n)
    visible = np.bincount(of, length, minlength=n_rows)
    letters = np.bincount(of, small + capital, minlength=n_rows) / np.maximum(1, visible)
    distinct = np.bincount(_distinct(of, name), minlength=n_rows) / np.maximum(1, n)
    found = np.stack(
        (
            share((symbol >= 2) & (length > symbol)),
            share((capital >= 2) & (small == 0)),
            share(bar),
            share(repeat),
            share(stop),
            distinct,
            letters,
        ),
        axis=1,
    )
    shape = np.minimum(symbol, 3) * 1000 + tail * 100 + np.minimum(capital, 2) * 30 + (small > 0) * 15 + repeat * 7 + bar * 4 + stop * 2 + (length > 12)
    return n, found, of, shape.astype(np.int64)


def _distinct(of: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The row of each distinct word of each row."""
    order = np.lexsort((name, of))
    o, w = of[order], name[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    return o[new]


_STOP = _word_list()


def votes(n: np.ndarray, found: np.ndarray) -> np.ndarray:
    out = np.zeros(found.shape, np.int8)
    for k, (_, least, junk_below, fine_from, fine_to, junk_above) in enumerate(LABELLERS):
        x = found[:, k]
        junk = x < junk_below if junk_below is not None else x > junk_above
        fine = x >= fine_from if fine_from is not None else x <= fine_to
        out[:, k] = np.where(n < least, ABSTAIN, np.where(junk, JUNK, np.where(fine, FINE, ABSTAIN)))
    return out


def features(n: np.ndarray, of: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed shapes and pairs of neighbouring shapes; few words say little."""
    out = np.zeros(len(n) * DIM)
    if len(of):
        single = mix(shape.astype(U) + U(1)) % U(DIM)
        before = np.concatenate(([0], np.where(of[1:] == of[:-1], shape[:-1] + 1, 0)))
        double = mix(shape.astype(U) * U(100_003) + before.astype(U) + U(1 << 40)) % U(DIM)
        for bucket in (single, double):
            out += np.bincount(of * DIM + bucket.astype(np.int64), minlength=len(out))
    return np.sqrt(out.reshape(len(n), DIM) / (n + 20.0)[:, None])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for votes that are independent given the class; a vote that was not given says nothing.

    Class 0 is fine; there is one class of junk for each labeller, as kinds of junk that one
    labeller sees and others miss are not one class.  A document with junk votes starts in
    the classes of those labellers.  Returns the probability of junk of each pattern, the
    classes' shares and P(vote | class, voted) as [class, labeller, vote].
    """
    kinds = (patterns == JUNK).astype(float)
    any_junk = kinds.sum(axis=1)
    p = np.concatenate((np.where(any_junk > 0, 0.05, 0.98)[None], kinds.T * 0.95 / np.maximum(1, any_junk)), axis=0)
    p[1:, any_junk == 0] = 0.02 / patterns.shape[1]
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    onehot[:, :, ABSTAIN] = 0
    for _ in range(rounds):
        weight = p * counts
        table = np.einsum("ci,ikv->ckv", weight, onehot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 0.1) / (weight.sum() + 0.1 * len(p))
        score = np.log(share)[:, None] + np.einsum("ikv,ckv->ci", onehot, np.log(table))
        p = np.exp(score - score.max(axis=0))
        p /= p.sum(axis=0)
    return p[1:].sum(axis=0), share, table


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias, about the share of junk."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    w, square = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -50, 50)))  # no copy of x in another precision
        g = x.T @ (p - y).astype(x.dtype) / len(x) + l2 * w
        square += g * g
        w -= rate * 0.3 * g / np.sqrt(square)
    return w


def _vote(batches):
    for b in batches:
        data, at = binary(b.column("bytes"))
        out = []
        for i, j in slices(at):
            n, found, _, _ = measure(data[at[i] : at[j]], at[i : j + 1] - at[i])
            out += ["".join(map(str, v)) for v in votes(n, found)]
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, pa.string())], ["k1", "k2", "votes"])


def _scored(batches, names: list[str], use):
    for b in batches:
        data, at = binary(b.column("bytes"))
        out = []
        for i, j in slices(at):
            n, _, of, shape = measure(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for a in range(0, j - i, 512):  # few rows at once: features are dense
                e = min(a + 512, j - i)
                part = slice(*np.searchsorted(of, (a, e)))
                out.append(use(features(n[a:e], of[part] - a, shape[part])))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), np_array(out)], [*names, "out"])


def np_array(parts: list[np.ndarray]) -> pa.Array:
    if not parts:
        return pa.array([], pa.float64())
    x = np.concatenate(parts)
    return pa.array(x) if x.ndim == 1 else pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())


def classify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, votes, posterior, score, kept, k1, k2.

    votes has a digit for each labeller (0 nothing, 1 fine, 2 junk); posterior is the weak
    label's, score the scorer's probability of junk; a document is kept if its score is below
    REJECT.  Texts without words (null, empty) are not judged: score 0, kept.  Equal rows get
    equal results; a null doc_id is treated like others; an empty table gives no rows; other
    columns of docs are not read.  Scores that tie with REJECT are rejected; a very long text is
    measured as a whole, whatever its length.
    """
    spark = docs.sparkSession
    texts = with_row_key(docs.select("doc_id", "text")).select("k1", "k2", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    voted = keep(texts.mapInArrow(_vote, "k1 long, k2 long, votes string"), "votes")
    pattern = [(r["votes"], r["count"]) for r in voted.groupBy("votes").count().orderBy("votes").collect()]
    if not pattern:
        return spark.createDataFrame([], "doc_id long, votes string, posterior double, score double, kept boolean, k1 long, k2 long")
    names = [v for v, _ in pattern]
    junk, _, _ = fit_labellers(np.array([[int(c) for c in v] for v in names], np.int8), np.array([n for _, n in pattern], float))
    weak = spark.createDataFrame(list(zip(names, junk.tolist(), strict=True)), "votes string, posterior double")
    posterior = voted.join(F.broadcast(weak), "votes")  # at most 3^7 rows
    # a row repeated any number of times trains once; the draw, not the label, decides what trains
    keys = keep(posterior.groupBy("k1", "k2").agg(F.first("votes").alias("votes"), F.first("posterior").alias("posterior")), "keys")
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit("train")), F.lit(1 << 30))
    chosen = keep(
        keys.where(draw < F.lit(int(min(1.0, 1.5 * MAX_TRAIN / keys.count()) * (1 << 30)))).orderBy(draw, "k1", "k2").limit(MAX_TRAIN).select("k1", "k2", "posterior"), "train"
    )
    rows = (
        join_small(texts, chosen, ["k1", "k2"], "inner", 64)
        .select("k1", "k2", "posterior", "bytes")
        .mapInArrow(lambda b: _scored(b, ["k1", "k2", "posterior"], lambda x: x), "k1 long, k2 long, posterior double, out binary")
        .groupBy("k1", "k2")
        .agg(F.first("posterior").alias("posterior"), F.min("out").alias("out"))
        .orderBy("k1", "k2")
        .collect()  # MAX_TRAIN rows at most
    )
    w = fit_scorer(np.stack([np.frombuffer(r["out"], np.float32) for r in rows]), np.array([r["posterior"] for r in rows]))

    def use(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))
        return np.where(x.any(axis=1), p, 0.0)

    scored = texts.select("k1", "k2", "bytes").mapInArrow(lambda b: _scored(b, ["k1", "k2"], use), "k1 long, k2 long, out double")
    meet = scored.join(keys, ["k1", "k2"])
    return meet.select(
        doc_id_of().alias("doc_id"), "votes", "posterior", F.col("out").alias("score"), (F.col("out") < REJECT).alias("kept"), "k1", "k2"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; columns as they are.

    Null, empty and wordless texts stay, whatever their length long texts are measured whole,
    scores that tie with REJECT go, repeated rows go or stay together, an empty table gives no
    rows, and columns may have any name (`classify` tells the rest)."""
    keyed, key = with_fresh_key(docs)
    rejected = keep(classify(docs).where(~F.col("kept")).select("k1", "k2").distinct().toDF(*key), "rejected")
    return join_small(keyed, rejected, key, "left_anti", 32).select(*docs.columns)
