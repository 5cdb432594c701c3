import numpy as np

from tremor.llm.hard_negatives import Tree, labelled, mine
from tremor.llm.integers import limbs, order_key, products, square_sums, whole

NAN, INF = float("nan"), float("inf")


def brute(rows, anchor, positives=5, negatives=3, scale=256):
    full = []
    for i, v, g in dict.fromkeys((i, tuple(v) if v is not None else None, g) for i, v, g in rows):
        if i is not None and g is not None and v and all(x is not None and np.isfinite(x) and np.isfinite(x * scale) for x in v):
            full.append((i, [int(np.floor(x * scale)) for x in v], g))
    full = [full[k] for k in sorted({(i, tuple(v), g): k for k, (i, v, g) in enumerate(full)}.values())]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, g in full:
        if anchor(i):
            others = [(-dot(v, u), j, h) for j, u, h in full if j != i and len(u) == len(v)]
            for s, j, _ in sorted(x for x in others if x[2] == g)[:positives]:
                p = -s
                found = sorted(x for x in others if x[2] != g and 50 * p <= -100 * x[0] <= 95 * p)[:negatives]
                out += [(i, j, k + 1, b, p, -n) for k, (n, b, _) in enumerate(found)]
    return sorted(out)


def got(spark, rows, every):
    df = labelled(spark.createDataFrame([(*r, 1, "v") for r in rows], "vec_id long, embedding array<double>, label int, d int, anchor string"))
    return sorted(map(tuple, mine(df, df.where(f"vec_id % {every} = 0")).collect()))


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    c = r.normal(size=(6, 12))
    rows = [(i, (c[i % 6] * r.choice([0.0, 0.3, 1.0]) + r.normal(size=12) * 0.4).tolist(), int(r.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in r.integers(-1, 2, 3)], i % 2) for i in range(60)]  # ties, zero scores, another length
    rows += [(2000, None, 1), (2005, [NAN] * 12, 1), (2010, [INF] + [1.0] * 11, 1), (2015, [None] + [1.0] * 11, 1), (2020, [], 1), (2025, rows[0][1], None), (None, rows[0][1], 1), (2030, [1e308] * 12, 1)]
    rows += [rows[5], rows[5], rows[10], (15, rows[16][1], 1), (2035, [0.0] * 12, 2), (2040, [-x for x in rows[0][1]], rows[0][2])]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 500 and got(spark, rows, 5) == want


def test_large_components_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, (np.floor(r.normal(size=4) * 1e15)).tolist(), i % 2) for i in range(40)] + [(100 + i, [3e7 + i, 1.0, -2.0, float(i)], i % 2) for i in range(20)]
    want = brute(rows, lambda i: i % 5 == 0)
    long = lambda n: n if -(2**63) <= n < 2**63 else None
    assert sorted(got(spark, rows, 5), key=str) == sorted(((a, p, k, n, long(s), long(t)) for a, p, k, n, s, t in want), key=str)
    assert any(abs(t[5]) > 2**63 for t in want)


def test_empty(spark):
    assert got(spark, [(1, [1.0], None)], 1) == []
    none = labelled(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert mine(none, none).collect() == []


def test_annulus_leaves_rows_out():
    """On clustered vectors the triangle inequality rules most rows out, inside and outside the annulus."""
    r = np.random.default_rng(3)
    c = r.normal(size=(64, 3))
    c *= 4000 / np.linalg.norm(c, axis=1, keepdims=True)  # embeddings of one norm
    x = np.floor(np.repeat(c, 64, axis=0) + r.normal(size=(4096, 3)) * 20)
    tree = Tree.grow(x, 64)
    ids, met = np.arange(len(x)), 0
    for q in x[::512]:
        score = (tree.raw @ q).astype(np.int64)
        lo, hi = int(score.max()) // 2, int(score.max()) * 95 // 100
        (found,), n = tree.search(q, np.ones(len(x), bool), ids, [(lo, hi)], 3)
        want = sorted((-int(s), int(i), int(i)) for i, s in enumerate(score) if lo <= s <= hi)[:3]
        assert found == want
        met += n
    assert met < 0.3 * 8 * len(x), met  # few dimensions: in many, a triangle says little


def test_digit_slices():
    r = np.random.default_rng(5)
    for top in (9, 2**30, 2**61, 10**40):
        draw = lambda *s: np.array([int(r.integers(-9, 10)) * top // 9 + int(r.integers(0, 9)) for _ in range(int(np.prod(s)))], dtype=object if top > 2**62 else np.int64).reshape(s)  # noqa: E731, B023
        a, b = draw(6, 50), draw(50, 4)
        assert (products(a, b) == a.astype(object) @ b.astype(object)).all() and (square_sums(a) == (a.astype(object) ** 2).sum(axis=1)).all()
        cut = limbs(a, 20)
        assert max(np.abs(x).max() for x in cut) < 2**20 and (sum(x.astype(np.int64).astype(object) << (20 * k) for k, x in enumerate(cut)) == a).all()
    assert whole(np.array([1e300])).tolist() == [int(1e300)]
    numbers = [0, 1, -1, 255, 256, -255, -256, 10**30, -(10**30), 10**31]
    assert sorted(numbers, key=order_key) == sorted(numbers)
