import numpy as np

from tremor.llm.embedding_dedup import near_duplicate_vectors
from tremor.llm.topk_search import search, top_k

NAN, INF = float("nan"), float("inf")


def make(seed=0, groups=60, dim=24):
    r = np.random.default_rng(seed)
    rows, label = [], {}
    for g in range(groups):
        c = r.normal(size=dim)
        for k in range(r.integers(1, 9)):
            v = c * r.uniform(0.5, 2) + r.normal(size=dim) * r.choice([0.0, 0.1, 0.18])
            label[len(rows)] = g % 4 if r.random() < 0.9 else 3
            rows.append((len(rows), v.tolist(), label[len(rows)]))
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [NAN] * dim, 1), (n + 3, [INF] + [1.0] * (dim - 1), 1), (n + 4, [None] + [1.0] * (dim - 1), 1)]
    odd += [(n + 5, rows[0][1], None), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], 1), (None, rows[3][1], rows[3][2]), rows[4], rows[4], (n + 9, [-0.0, 1.0], 2), (n + 10, [0.0, 1.0], 2)]
    return rows + odd


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links(spark):
    rows = make()
    got = near_duplicate_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int")).collect()
    assert len(got) == len(rows)
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = [(d, links[i], least.get(find(i), None), least.get(find(i)) == d) for i, (d, *_) in enumerate(rows)]
    got = [tuple(g) for g in got]
    total = sum(links)
    assert sum(g[1] for g in got) >= 0.98 * total and sum(g[1] for g in got) <= total
    assert len(set(map(str, want)) - set(map(str, got))) <= 0.02 * len(want)


def test_recall_with_many_pivots(spark):
    r = np.random.default_rng(5)
    c = r.normal(size=(900, 32))
    rows = [(i, (c[i % 900] + 0.12 * r.normal(size=32)).tolist(), 1) for i in range(3600)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    total = int(((x @ x.T) >= 0.98).sum()) - len(rows)
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sum(g.n_links for g in got)
    assert 0.9 * total <= found <= total and total > 1000


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicate_vectors(none).collect() == [] and top_k(none, none).collect() == []


def test_top_k(spark):
    rows = [(i, v, g) for i, v, g in make(1) if i is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 10 = 0"), k=5, scale=16).collect()))
    full = [(i, np.floor(16 * np.array(v))) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {i: x for i, x in full if i % 10 == 0}.items():
        best = sorted((-int(a @ x), i) for i, x in full if i != q and len(x) == len(a))[:5]  # every row but the query's own
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_repeated_rows_are_candidates_each(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.1, 0.1])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, df.where("vec_id = 3"), k=3).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 1, 2]
    assert [r.vec_id for r in top_k(df, df.where("vec_id = 1"), k=3).orderBy("rank").collect()] == [2, 2, 3]


def test_exact_mode_and_recall_on_clustered_vectors(spark):
    r = np.random.default_rng(11)
    c = r.normal(size=(40, 48))
    rows = [(i, (c[i % 40] + 0.25 * r.normal(size=48)).tolist(), i % 2) for i in range(2400)]
    rows += [(5000 + i, (np.array(rows[i][1]) + 0.09 * r.normal(size=48)).tolist(), rows[i][2]) for i in range(600)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([g for *_, g in rows])
    total = int(((x @ x.T >= 0.98) & (label[:, None] == label)).sum()) - len(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = lambda **more: sum(g.n_links for g in near_duplicate_vectors(df, **more).collect())
    assert total > 500 and 0.9 * total <= found() <= total and found(exact=True) == total


def test_no_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, near_duplicate_vectors(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_search_leaves_most_rows_out():
    r = np.random.default_rng(3)
    x = np.floor(1024 * np.cumsum(r.normal(size=(4000, 64)), axis=1))
    q = x[:20]
    of, at, score, exact = search(q, np.arange(20), x, np.arange(4000), 10)
    full = q @ x.T
    full[np.arange(20), np.arange(20)] = -np.inf
    assert exact < 0.3 * full.size
    for i in range(20):
        assert (score[of == i] == np.sort(full[i])[::-1][:10]).all()


def test_rare_lengths_are_compared(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=64).tolist(), 1) for i in range(700)]
    for k in range(20):
        v = r.normal(size=8)
        rows += [(2000 + k, v.tolist(), 1), (3000 + k, (v * 1.5 + 0.01 * r.normal(size=8)).tolist(), 1)]
    for k in range(12):
        v = r.normal(size=3 + k)  # lengths met twice
        rows += [(4000 + k, v.tolist(), 1), (5000 + k, (-v).tolist(), 1), (6000 + k, (v * 2).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for exact in (False, True):
        links = {g.vec_id: g.n_links for g in near_duplicate_vectors(df, exact=exact).collect()}
        assert all(links[2000 + k] >= 1 and links[3000 + k] >= 1 for k in range(20)) and all(links[4000 + k] == links[6000 + k] == 1 for k in range(12))


def test_scores_of_large_components_are_exact(spark):
    r = np.random.default_rng(9)
    rows = [(i, (np.floor(r.normal(size=5) * 1e15)).tolist()) for i in range(60)] + [(100 + i, (r.normal(size=5) * 3e9).tolist()) for i in range(40)]
    rows += [(200, [1e300, 1.0, 1.0, 1.0, 1.0]), (201, [-1e300, 1.0, 1.0, 1.0, 1.0]), (202, [1e308] * 5), (204, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((q.query_id, q.rank, q.vec_id, q.score) for q in top_k(df, df.where("vec_id % 4 = 0"), k=6, scale=1024).collect()))
    full = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows if np.isfinite(v[0] * 1024)}
    want = []
    for q in full:
        if q % 4 == 0:
            best = sorted((-sum(a * b for a, b in zip(full[q], v)), i) for i, v in full.items() if i != q)[:6]
            want += [(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and any(s is None for *_, s in want) and any(s is not None for *_, s in want)


def test_queries_of_one_id_are_answered_each_for_itself(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((q.rank, q.vec_id) for q in top_k(df, df.where("vec_id = 1"), k=2, scale=1).collect())
    assert got == [(1, 2), (1, 3), (2, 4), (2, 4)]


def test_recall_over_fifty_thousand_vectors():
    """The rule that decides which pairs are compared, on vectors as many as check_l has."""
    from tremor.llm.embedding_dedup import APART, BLOCK, PREFIX, SHARED, _describe, _unit

    import pyarrow as pa

    r = np.random.default_rng(4)
    n, dim, labels = 50_000, 64, 10
    c = r.normal(size=(500, dim))
    x = c[r.integers(0, 500, n)] * r.choice([0.0, 0.5], n)[:, None] + r.normal(size=(n, dim))
    pairs = 2000
    y = x[:pairs] + r.normal(size=(pairs, dim)) * 0.12 * np.linalg.norm(x[:pairs], axis=1, keepdims=True) / np.sqrt(dim)
    near_enough = (_unit(x[:pairs]) * _unit(y)).sum(axis=1) >= 0.98
    pivots = _unit(x[r.permutation(n)[: 2 * PREFIX * (n // labels) // BLOCK + PREFIX]])

    def near(v):
        batch = pa.record_batch({"class": pa.array(range(len(v))), "label": ["a"] * len(v), "n": [1] * len(v), "vector": pa.array(list(v), pa.list_(pa.float64()))})
        (out,) = _describe({dim: pivots}, PREFIX)([batch])
        return np.array(out.column("near").to_pylist())

    a, b = near(x[:pairs]), near(y)
    met = 0
    for p, q in zip(a[near_enough], b[near_enough], strict=True):
        shared, i, j = np.intersect1d(p, q, return_indices=True)
        met += len(shared) >= SHARED and np.abs(i - j).mean() <= APART
    assert near_enough.sum() > 500 and met >= 0.95 * near_enough.sum()
