import numpy as np
import pytest

from tremor.llm import topk_search
from tremor.llm.topk_search import search, top_k


def plain(query, query_id, x, x_id, k):
    out = []
    for i, q in enumerate(query):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), int(x_id[j])) for j, v in enumerate(x) if x_id[j] != query_id[i])
        out += [(i, n, -s) for s, n in scores[:k]]
    return out


def test_queries_are_sent_to_chunks_and_not_broadcast(spark):
    r = np.random.default_rng(1)
    v = np.floor(1024 * r.normal(size=(12_000, 64)) / 8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")  # 6,000 queries are 3 MB, for all chunks many times that
    try:
        got = sorted(map(tuple, top_k(df, df.where("vec_id % 2 = 0"), k=3, scale=1).collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = []
    for q in range(0, len(v), 2):
        s = v @ v[q]
        s[q] = -np.inf
        want += [(q, n + 1, int(j), int(s[j])) for n, j in enumerate(np.lexsort((np.arange(len(v)), -s))[:3])]
    assert got == sorted(want)


@pytest.mark.parametrize("large", [3, 5000, 1e7, 1e15, 1e20])
def test_tiles_keep_ties_and_leave_out_own_rows(monkeypatch, large):
    """Products in single and double precision, and Python integers."""
    monkeypatch.setattr(topk_search, "TILE", 7)
    monkeypatch.setattr(topk_search, "SLAB", 3)
    r = np.random.default_rng(4)
    for n, m, d, k, dense in [(40, 8, 5, 4, 0.0), (40, 8, 5, 4, 2.0), (3, 4, 2, 5, 0.0), (30, 5, 1, 3, 1 / 16), (29, 7, 20, 10, 0.0)]:
        monkeypatch.setattr(topk_search, "DENSE", dense)
        x = np.rint(r.integers(-3, 4, size=(n, d)) * (large / 3))
        x_id = r.integers(0, n, size=n)  # some repeat
        query, query_id = x[:m].copy(), np.concatenate([x_id[: m - 1], [10**6]])[: len(x[:m])]
        of, at, score, _ = search(query, query_id, x, x_id, k)
        assert [(i, x_id[j], int(s)) for i, j, s in zip(of, at, score)] == plain(query, query_id, x, x_id, k)


def test_rows_of_one_id_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 10)
    df = spark.createDataFrame([(7, [float(i), 1.0]) for i in range(600)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, asked, k=4, scale=1).orderBy("rank").collect()]
    assert got == [(1, n + 1, 7, 599 - n) for n in range(4)]
