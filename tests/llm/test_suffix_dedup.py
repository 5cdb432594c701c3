import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tremor.llm.bytehash import SLICE
from tremor.llm.suffix_dedup import _CONTEXT, _PART, _argmin_windows, _contexts, _cut, remove_repeats

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, k):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + k] for t in texts for p in range(len(t) - k + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - k + 1):
            if seen[t[p : p + k]] > 1:
                gone[p : p + k] = [True] * k
        rest = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, rows, k):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bytes string")
    got = [tuple(r) for r in remove_repeats(docs, k).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, k), key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    passage, other = word(150), word(90)
    rows = [(i, word(r.randint(0, 300))) for i in range(40)]
    rows += [(100 + i, word(r.randint(0, 80)) + passage[i * 5 :] + word(30) + other[: 90 - i]) for i in range(12)]
    rows += [(200, passage), (200, passage), (None, passage + passage), (201, None), (202, ""), (203, "ab" * 120), (204, "a" * 200)]
    rows += [(205, passage[3:71]), (206, word(5) + other[11:77])]
    check(spark, rows, 40)
    check(spark, rows, 33)


def test_empty_table(spark):
    check(spark, [], 40)


def test_hot_passage(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    passage = word(90)
    rows = [(i, word(r.randint(0, 40)) + passage[: 90 - i % 47] + word(30)) for i in range(150)]
    check(spark, rows, 40)


def test_text_longer_than_a_slice(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefgh \n", k=n))
    long, part = word(600_000), word(900)
    assert len(long) > 2 * SLICE
    cut = SLICE - 500  # a repeat across the border of two slices
    rows = [(1, long[:cut] + part + long[cut:] + part), (2, word(50) + long[SLICE - 250 : SLICE + 400]), (3, long[500_000:500_399]), (4, part[7:])]
    check(spark, rows, 400)


def test_representatives_follow_the_window_only():
    value = np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.uint64)
    value[50:60] = value[50] >> np.uint64(12) << np.uint64(12)
    value[50:60] += np.arange(10, 0, -1).astype(np.uint64)
    assert (_argmin_windows(value[:300], 101) == _argmin_windows(value, 101)[:200]).all()


def test_long_batches_come_back_in_parts():
    r, n, size, length = random.Random(5), 60, 100_000, 400
    texts = [r.randbytes(size) if k % 7 else b"" for k in range(n)]
    keys = pa.array(range(n), pa.int64())
    places = [[] if not t or k % 3 == 0 else [(0, 9), (5_000, 5_100)] for k, t in enumerate(texts)]
    cut = [[{"lo": a, "hi": e} for a, e in x] or None for x in places]
    parts = list(_cut(length)([pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.binary()), pa.array(cut)], ["k1", "bytes", "spans"])]))
    rows = [tuple(x.values()) for b in parts for x in b.to_pylist()]
    kept = [t if not x else t[409:5_000] + t[5_500:] for t, x in zip(texts, places, strict=True)]
    assert rows == [(k, len(t), len(t) - len(w), 2 * bool(places[k]), w) for k, (t, w) in enumerate(zip(texts, kept, strict=True))]
    assert max(b.nbytes for b in parts) < _PART + size + 50 * n

    span = lambda k, a, e: {"name": k, "w1": a, "w2": e, "copies": 2, "lo": a, "hi": e}
    many = [[span(k, a, a + 99) for a in range(0, len(texts[k]) - 500, 100)] for k in range(n)]
    parts = list(_contexts(length)([pa.RecordBatch.from_arrays([keys, keys, pa.array(texts, pa.binary()), pa.array(many)], ["k1", "k2", "bytes", "spans"])]))
    rows = [tuple(x[c] for c in _CONTEXT) for b in parts for x in b.to_pylist()]
    assert rows == [(k, x["lo"], x["hi"], 2, k, k, x["lo"], texts[k][x["lo"] : x["hi"] + length]) for k in range(n) for x in many[k]]
    assert max(b.nbytes for b in parts) < 7 * _PART
