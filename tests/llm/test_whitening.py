from fractions import Fraction

import numpy as np

from tremor.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, n int, x string")


def check(spark, rows, scale=256, components=4):
    """Against exact fractions, length by length."""
    used = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(c * scale)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    got = whiten(frame(spark, rows), scale, components).collect()
    assert len(got) == sum(min(components, len(v)) for _, v in used)
    for d in {len(v) for _, v in used}:
        mine = [(i, tuple(v)) for i, v in used if len(v) == d]
        fit = sorted({v for _, v in mine})
        n, total = len(fit), [sum(c) for c in zip(*fit)]
        away = [[Fraction(x) - Fraction(s, n) for x, s in zip(v, total)] for v in fit]
        cov = [[sum(a[i] * a[j] for a in away) / n for j in range(d)] for i in range(d)]
        value, vector = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
        trace = float(sum(cov[i][i] for i in range(d)))
        of = {}
        for r in got:
            of.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
        z = {}
        for i, v in mine:
            deviation = sum((n * x - s) ** 2 for x, s in zip(v, total))
            for k in range(1, min(components, d) + 1):
                r = next(r for r in of[i, deviation if deviation < 10**38 else None, k] if r.n == n)
                e = value[-k]
                if e > 1e-9 * trace:
                    assert abs(r.explained - e / trace) < 1e-9
                    p = sum(float(Fraction(x) - Fraction(s, n)) * a for x, s, a in zip(v, total, vector[:, -k])) / np.sqrt(e)
                    assert abs(abs(r.whitened) - abs(p)) < 1e-6 and r.identity_error < 1e-8
                    z.setdefault(k, {})[v] = r.whitened
                else:
                    assert r.whitened is None and r.explained < 1e-12
        if z:  # one sign for all rows: the whitened list has the identity as its covariance
            m = np.array([[z[k][v] for v in fit] for k in sorted(z)])
            m = m - m.mean(axis=1, keepdims=True)
            assert np.abs(m @ m.T / n - np.eye(len(m))).max() < 1e-8


def test_exact_rows(spark):
    r = np.random.default_rng(0)
    mix = r.normal(size=(6, 6)) * np.array([3, 2, 1.2, 0.7, 0.4, 0.2])
    rows = [(i, (r.normal(size=6) @ mix + 5).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 700)]  # copies count once in the fit
    rows += [rows[1], (None, rows[2][1]), (800, None), (801, [NAN] * 6), (802, [INF] * 6), (803, [None] * 6), (804, []), (805, [1.0, 2.0]), (806, [2.0, 1.0]), (807, [5.0, -1.0]), (808, [4.0])]
    check(spark, rows)


def test_large_values_and_dependent_dimensions(spark):
    r = np.random.default_rng(1)
    base = np.floor(r.normal(size=(60, 3)) * 1e12)
    check(spark, [(i, [*v, v[0] + v[1]]) for i, v in enumerate(base.tolist())])
    check(spark, [(i, (v * 1e5).tolist()) for i, v in enumerate(base)] + [(99, [1e300, 0.0, -1e300])])


def test_empty_and_single(spark):
    assert whiten(frame(spark, [(1, None)])).collect() == []
    (one,) = whiten(frame(spark, [(1, [0.5])])).collect()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, 0.0, 0.0)


def test_many_blocks_add_up(spark):
    r = np.random.default_rng(2)
    check(spark, [(i, v) for i, v in enumerate((r.normal(size=(9000, 3)) * [9, 4, 1]).tolist())], components=2)
