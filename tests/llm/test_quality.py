import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm.quality import FINE, JUNK, LABELLERS, STOP_WORDS, classify, fit_labellers, keep_good

DATA = "/root/testdata/sf0.01"


def test_em_recovers_accuracies():
    """Two kinds of junk, each seen by two labellers of three or more, and unequal accuracies."""
    r = np.random.default_rng(0)
    truth = np.where(r.random(30_000) < 0.25, r.integers(1, 3, 30_000), 0)
    seen = np.array([[0.01, 0.02, 0.02, 0.05], [0.9, 0.8, 0.02, 0.3], [0.02, 0.05, 0.9, 0.8]])[truth]  # P(junk vote)
    v = np.where(r.random(seen.shape) < seen, JUNK, FINE)
    v[r.random(v.shape) < 0.1] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    p, share, table = fit_labellers(patterns, counts.astype(float), rounds=200)
    rate = table[0, :, JUNK] / (table[0, :, FINE] + table[0, :, JUNK])
    assert rate.max() < 0.15 and abs(share[0] - 0.75) < 0.15, (rate, share)
    order = {tuple(x): q for x, q in zip(patterns, p, strict=True)}
    assert np.mean([(order[tuple(x)] > 0.5) == (t > 0) for x, t in zip(v, truth, strict=True)]) > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = classify(docs).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    good, bad = [g for g in got if g.quality == 1], [g for g in got if g.quality == 0]
    assert sum(g.kept for g in good) >= 0.995 * len(good)
    assert sum(not g.kept for g in bad) >= 0.95 * len(bad)
    assert len(got[0].votes) == len(LABELLERS)


def test_odd_rows(spark):
    fine = [(i, f"The cat number {i} sat on the mat, and it was good for all of us in the end of day {i * 7}.", 0.5) for i in range(40)]
    junk = [(100 + i, "BUY!! NOW!! CHEAP!! " * (5 + i), 0.5) for i in range(10)]
    rows = [*fine, *junk, (None, None, 0.5), (200, "", 0.5), (200, "", 0.5), (201, "\n ", 0.5), (None, junk[0][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("k1", F.lit(1)).withColumn("K2", F.lit(2))
    got = classify(docs).collect()
    assert len(got) == len(rows)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(40)) <= set(ids) and ids.count(200) == 2 and not any(d and 100 <= d < 110 for d in ids)
    assert classify(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_votes(text):
    """The labellers word by word, on UTF-8 bytes as the operator counts them."""
    w = [x.encode() for x in words_of(text)]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    symbols, capitals = set(b"!#$%&*+/<=>@[\\]^_`{|}~"), set(range(65, 91))
    stop, marks = {x.encode() for x in STOP_WORDS}, set(b".,;:?'\"-()")
    small = lambda x: sum(97 <= c <= 122 or not (c in symbols or c in capitals or 48 <= c <= 57 or c in marks) for c in x)
    n, share = len(w), lambda flags: sum(flags) / max(1, len(w))
    found = {
        "symbols": share(sum(c in symbols for c in x) >= 2 and any(c not in symbols for c in x) for x in w),
        "capitals": share(sum(c in capitals for c in x) >= 2 and not small(x) for x in w),
        "tables": share(x == b"|" for x in w),
        "repeats": share(k > 0 and x == low[k - 1] for k, x in enumerate(low)),
        "stop_words": share(x in stop or (len(x) > 1 and x[-1] in marks and x[:-1] in stop) for x in low),
        "distinct": len(set(low)) / max(1, n),
        "letters": sum(small(x) + sum(c in capitals for c in x) for x in w) / max(1, sum(map(len, w))),
    }
    out = ""
    for name, least, junk_below, fine_from, fine_to, junk_above in LABELLERS:
        x = found[name]
        junk = x < junk_below if junk_below is not None else x > junk_above
        fine = x >= fine_from if fine_from is not None else x <= fine_to
        out += "0" if n < least else "2" if junk else "1" if fine else "0"
    return out


def brute_posteriors(votes):
    """EM in plain Python over documents, one class of fine text and one of junk for each labeller."""
    k, classes = len(LABELLERS), len(LABELLERS) + 1
    p = []
    for v in votes:
        junk = v.count("2")
        p.append([0.05 if junk else 0.98] + [(0.95 / junk if c == "2" else 0.0) if junk else 0.02 / k for c in v])
    for _ in range(60):
        table = [[[0.1, 0.1, 0.1] for _ in range(k)] for _ in range(classes)]
        share = [0.1] * classes
        for v, q in zip(votes, p):
            for c in range(classes):
                share[c] += q[c]
                for j, x in enumerate(v):
                    if x != "0":
                        table[c][j][int(x)] += q[c]
        total = sum(share)
        for c in range(classes):
            for j in range(k):
                s = sum(table[c][j])
                table[c][j] = [x / s for x in table[c][j]]
        for i, v in enumerate(votes):
            logs = [math.log(share[c] / total) + sum(math.log(table[c][j][int(x)]) for j, x in enumerate(v) if x != "0") for c in range(classes)]
            e = [math.exp(x - max(logs)) for x in logs]
            p[i] = [x / sum(e) for x in e]
    return [sum(q[1:]) for q in p]


def test_against_brute_force(spark):
    r = random.Random(6)
    plain = "the of and to in is a it for with river stone window morning paper letter garden Ñandú höher evening quiet walk".split()
    rows = []
    for i in range(160):
        words = [r.choice(plain) for _ in range(r.randint(1, 90))]
        if i % 5 == 0:
            words = [r.choice(["BUY!!", "NOW", "$$$", "100%", "|", "WIN@@x", "the"]) for _ in words]
        if i % 7 == 0:
            words = [w for w in words for _ in (0, 1)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words) + r.choice([".", "", "!"])))
    rows += [(900, None), (901, ""), (902, rows[5][1]), (902, rows[5][1]), (903, "the river and " * 60_000)]
    got = classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    votes = [brute_votes(t or "") for _, t in rows]
    want = dict(zip(votes, brute_posteriors(votes), strict=True))
    by = {d: v for (d, _), v in zip(rows, votes, strict=True)}
    assert len(got) == len(rows)
    for g in got:
        assert g.votes == by[g.doc_id] and abs(g.posterior - want[g.votes]) < 1e-6
        assert g.kept == (g.score < 0.5) and (words_of(dict(rows)[g.doc_id] or "") or (g.score == 0 and g.kept))
    # the scorer agrees with the weak labels it learnt from, on nearly all texts
    assert sum((g.score >= 0.5) == (g.posterior >= 0.5) for g in got if by[g.doc_id].strip("0")) >= 0.9 * len(got)


def test_a_row_repeated_often_does_not_push_junk_out_of_training(spark):
    r = random.Random(8)
    plain = "the of and to in is a it for with river stone window morning paper letter garden evening quiet walk".split()
    plain += ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(300)]
    fine = [(i, " ".join(r.choice(plain[:12] if r.random() < 0.4 else plain) for _ in range(60))) for i in range(200)]
    junk = [(1000 + i, " ".join(r.choice(["BUY!!", "NOW##", "$$$x", "100%%", "WIN@@x", "the"]) for _ in range(60))) for i in range(200)]
    once = spark.createDataFrame(fine + junk, "doc_id long, text string")
    often = once.where("doc_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).drop("n")
    got = classify(once.union(often)).select("doc_id", "kept").distinct().collect()
    assert len(got) == 400 and all(g.kept == (g.doc_id < 1000) for g in got)


def test_scores_that_tie_with_the_limit_are_rejected(spark, monkeypatch):
    from tremor.llm import quality

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    score = {g.doc_id: g.score for g in classify(docs).collect()}
    monkeypatch.setattr(quality, "REJECT", score[1])
    assert {g.doc_id: g.kept for g in classify(docs).collect()} == {1: False, 2: True}
