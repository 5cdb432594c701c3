import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tremor.llm import ngram_lm
from tremor.llm.common import pack_bytes
from tremor.llm.elias_fano import EliasFano, NgramTrie, probability, quantise


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, least=2):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            three.update(zip(["<s>", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    stored = lambda count, total: probability(quantise(np.array([math.log10(count / total)])))[0]
    out = {}
    for (d, t), h in zip(rows, held, strict=True):
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for k, x in enumerate(w):
            u = w[k - 1] if k else "<s>"
            c = one[u] if k else one[None]
            p = c / (c + 5.0) * (stored(two[u, x], c) if two[u, x] else 0.0) + 5.0 / (c + 5.0) * (one[x] + 1) / (n + v + 1)
            if k:
                before = w[k - 2] if k > 1 else "<s>"
                c, many = two[before, u], three[before, u, x]
                p = c / (c + 5.0) * (stored(many, c) if many >= least else 0.0) + 5.0 / (c + 5.0) * p
            score += math.log10(p)
        out.setdefault(d, []).append((h, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Ärger", "the", "The"]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(150)]
    return rows + [(None, "the null"), (900, None), (901, ""), (902, "x " * 500), (3, rows[3][1]), (903, "unseen" * 100)]


@pytest.mark.parametrize(("size", "least"), [(1 << 21, 2), (300, 2), (300, 1), (1 << 21, 3)])
def test_against_brute_force(spark, monkeypatch, size, least):
    rows = corpus()
    monkeypatch.setattr(ngram_lm, "BATCH_TOKENS", size)
    monkeypatch.setattr(ngram_lm, "SHARD_PAIRS", size)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, batch int")
    want = brute(rows, least)
    got = ngram_lm.score_texts(docs, min_triple=least).collect()
    assert len(got) == len(rows)
    for g in got:
        assert any(tuple(g)[1:5] == w[:4] and abs(g.base_score - w[4]) < 1e-9 and abs(g.score - w[5]) < 1e-9 for w in want[g.doc_id])


def test_bigrams_predict_held_out_texts_better(spark):
    r = random.Random(2)
    follow = {i: r.choices(range(200), k=3) for i in range(200)}
    rows = []
    for d in range(300):
        w = [r.randrange(200)]
        for _ in range(40):
            w.append(r.choice(follow[w[-1]]))
        rows.append((d, " ".join(f"t{x}" for x in w)))
    got = [g for g in ngram_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if g.held_out]
    assert got and sum(g.score for g in got) > sum(g.base_score for g in got) + 10 * len(got)


def test_empty(spark):
    assert ngram_lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_elias_fano_round_trip():
    r = np.random.default_rng(1)
    for values in (np.array([0, 1 << 62, (1 << 63) - 1], np.uint64), [], [0], [5, 5, 5], np.sort(r.integers(0, 1 << 40, 5000)), np.sort(r.integers(0, 300, 100_000))):
        values = np.asarray(values, np.uint64)
        e = EliasFano.build(values)
        assert (e.decode() == values).all()
        if len(values):
            i = r.integers(0, len(values), 200)
            assert (e.access(i) == values[i]).all()
            t = np.append(r.integers(0, int(values[-1]), 199, endpoint=True), min(int(values[-1]) + 1, (1 << 63) - 1)).astype(np.uint64)
            zero = np.zeros(200, np.int64)
            assert (e.successor(zero, zero + len(values), t) == np.searchsorted(values, t)).all()


def test_trie_answers_by_successor_search(spark, monkeypatch):
    r = np.random.default_rng(2)
    contexts = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    pairs = {(int(i), int(w)): int(c) for i, w, c in zip(r.integers(0, len(contexts), 4000), r.integers(0, 1 << 63, 900)[r.integers(0, 900, 4000)], r.integers(1, 50, 4000))}
    order = sorted(pairs)
    ix, word = np.array([i for i, _ in order]), np.array([w for _, w in order], np.uint64)
    count = np.array([pairs[k] for k in order], float)
    totals = np.bincount(ix, count, minlength=len(contexts)).clip(1)
    trie = NgramTrie(contexts, totals, ix, word, count)
    ask = np.append(contexts, np.array([3, 1 << 62], np.uint64))
    choice = np.unique(word)
    run = r.integers(0, 200, len(ask))
    successor = r.choice(np.append(choice, [np.uint64(5)]), run.sum())
    code = trie.lookup(ask, run, successor)
    of = np.repeat(np.arange(len(ask)), run)
    for i, w, c in zip(of, successor, code):
        many = pairs.get((int(i), int(w)), 0) if i < len(contexts) else 0
        assert c == (quantise(np.log10(np.array([many / totals[i]])))[0] if many else 0)
    assert (code > 0).any() and not hasattr(trie, "lookup_sorted")


def test_queries_go_through_the_trie(spark, monkeypatch):
    monkeypatch.setattr(NgramTrie, "lookup", lambda self, context, run, successor: np.zeros(len(successor), np.uint8))
    pdf = pd.DataFrame({"shard": [0], "batch": [0], "contexts": [np.array([7], np.uint64).tobytes()], "context_totals": [pack_bytes(np.array([4]).tobytes())], "runs": [pack_bytes(np.array([1], np.uint32).tobytes())], "words": [np.array([9], np.uint64).tobytes()], "numbers": [pack_bytes(np.array([0], np.uint32).tobytes())], "counts": [pack_bytes(np.array([2], np.uint32).tobytes())]})
    assert ngram_lm._answer(1)(pdf)["codes"][0] == pack_bytes(b"\0")
    monkeypatch.undo()
    assert ngram_lm._answer(1)(pdf)["codes"][0] == pack_bytes(quantise(np.log10(np.array([0.5]))).tobytes())
