"""Order, windows that slide, stacks and spacing against plain versions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.config import Band, bands_table
from tremor.operators import align, peaks, sessions, spectral, view
from tremor.operators.order import Ordered

PSD = "capture_id string, axis string, session_id int, bin int, freq double, psd double"


def test_places_and_running_sums(spark):
    r = random.Random(0)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", "c", None]), r.randint(0, 10**6), k, r.randint(-9, 9)) for k in range(4000)]
    o = Ordered(spark.createDataFrame(rows, "key string, at long, id long, v long").repartition(7), ["key"], ["at", "id"])
    seen, total = {}, {}
    want = []
    for row in sorted(rows, key=lambda x: (x[0] or "", *x[1:])):
        place = seen[row[0]] = seen.get(row[0], -1) + 1
        total[row[0]] = total.get(row[0], 0) + row[3]
        want.append((*row, place, total[row[0]]))
    plain = lambda df: sorted(map(tuple, df.collect()), key=lambda x: (x[0] or "", *x[1:]))
    assert plain(o.placed("place")) == [w[:5] for w in want]
    assert plain(o.running("place", total="v")) == want
    # the hot key is spread over ranges: no task has to sort it, and sums run over a row a range
    assert o.rows.where("key = 'hot'").select("_row_part").distinct().count() >= 4
    assert Ordered(spark.createDataFrame([], "key string, at long"), ["key"], ["at"]).placed("p").collect() == []


def test_sessions_of_one_long_capture(spark):
    n = 3000
    rows = spark.range(n).select(F.lit("c").alias("capture_id"), F.lit("x").alias("axis"), (F.col("id") * 7 + 3).alias("arrival_ix"), (F.col("id") % 5 + 1.0).alias("fs"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("values"))
    out = sessions.assign_sessions(rows.orderBy(F.rand(3)), 8)
    got = sorted((r.session_id, r.arrival_ix) for r in out.collect())
    assert got == [(k // 8 + 1, 7 * k + 3) for k in range(n // 8 * 8)]
    told = sorted((r.arrival_ix, r.packets, r.mean_fs, r.duration) for r in sessions.progress(rows).collect())
    fs = np.cumsum([k % 5 + 1 for k in range(n)])
    assert told == [(7 * k + 3, k + 1, fs[k] / (k + 1), (k + 1) * 2 / (fs[k] / (k + 1))) for k in range(n)]


def test_median_of_a_bin_with_a_million_sessions(spark):
    n = 1_000_000
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0
    aligned = spark.range(n).select(F.lit("c").alias("capture_id"), F.lit("x").alias("axis"), F.col("id").cast("int").alias("session_id"), F.lit(0).alias("bin"), F.lit(1.0).alias("freq"), value.alias("psd"))
    o = Ordered(aligned.select("capture_id", "axis", "bin", "psd"), ["capture_id", "axis", "bin"], ["psd"])
    assert o.rows.select("_row_part").distinct().count() >= 4
    v = np.array(aligned.select("psd").toPandas()["psd"])
    r = align.bin_stats(aligned).first()
    assert (r.sessions, r.median) == (n, np.median(v)) and math.isclose(r.mean, v.mean(), rel_tol=1e-12) and math.isclose(r.std, v.std(), rel_tol=1e-9)


def test_medians_of_ties_and_small_bins(spark):
    r = random.Random(1)
    rows = [("c", a, s, b, float(b), float(r.randint(0, 3))) for a in "xy" for b in range(9) for s in range(r.randint(1, 12))]
    got = {(x.axis, x.bin): x.median for x in align.bin_stats(spark.createDataFrame(rows, PSD)).collect()}
    want = {}
    for _, a, _, b, _, p in rows:
        want.setdefault((a, b), []).append(p)
    assert got == {k: float(np.median(v)) for k, v in want.items()}


def test_interpolation_against_numpy(spark):
    r = np.random.default_rng(2)
    rows = []
    for s in range(1, 30):
        f = np.unique(np.round(np.cumsum(r.uniform(0.1, 1, 60)) * (1 + s / 100), 6))
        rows += [("c", "x", s, k, float(x), float(y)) for k, (x, y) in enumerate(zip(f, r.uniform(0, 9, len(f))))]
    of = {s: [(f, p) for _, _, t, _, f, p in rows if t == s] for s in range(1, 30)}
    low, high = max(v[0][0] for v in of.values()), min(v[-1][0] for v in of.values())
    grid = [f for f, _ in of[1] if low <= f <= high]
    got = {(x.session_id, x.bin): (x.freq, x.psd) for x in align.align(spark.createDataFrame(rows, PSD)).collect()}
    assert len(got) == 29 * len(grid)
    for s, points in of.items():
        want = np.interp(grid, *zip(*points))
        for b, f in enumerate(grid):
            assert got[s, b][0] == f and math.isclose(got[s, b][1], want[b], rel_tol=1e-12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 3))
def test_sliding_medians(values, window, tolerance):
    v = np.array(values, float)
    at = np.arange(len(v))
    parts = [(np.maximum(at - window, 0), np.maximum(at - tolerance, 0)), (np.minimum(at + tolerance + 1, len(v)), np.minimum(at + window + 1, len(v)))]
    floor, n = align.sliding_medians(v, parts)
    for i in at:
        near = [v[j] for j in at if tolerance < abs(j - i) <= window] if tolerance < window else []
        if tolerance < window:
            assert n[i] == len(near) and (not near or floor[i] == np.median(near))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30))
def test_walls(values):
    level = np.array(values, float)
    low, base = peaks.walls(level)
    for p in range(len(level)):
        higher = [k for k in range(p) if level[k] > level[p]]
        span = range(max(higher, default=-1) + 1, p + 1)
        assert low[p] == min(level[k] for k in span) and base[p] == max(k for k in span if level[k] == low[p])


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.integers(1, 8), st.randoms(use_true_random=False))
def test_kept_peaks_are_apart(places, distance, r):
    at = np.array(sorted(places))
    height = np.array([float(r.randint(0, 4)) for _ in at])
    stays = peaks.keep_apart(at, height, distance)
    kept = []
    for k in sorted(range(len(at)), key=lambda k: (-height[k], -at[k])):
        if all(abs(at[k] - at[j]) >= distance for j in kept):
            kept.append(k)
    assert sorted(np.flatnonzero(stays)) == sorted(kept)
    assert np.all(np.diff(at[stays]) >= distance)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 65), st.floats(0.5, 500), st.integers(0, 2**32 - 1))
def test_parseval(m, fs, seed):
    """A density's sum times its bin width is the windowed power of one segment."""
    x = np.random.default_rng(seed).normal(size=m)
    f, p = spectral.welch_psd(x, fs, m, 0)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    y = (x - x.mean()) * w
    assert math.isclose(p.sum() * fs / m, (y * y).sum() / (w * w).sum(), rel_tol=1e-7, abs_tol=1e-12) and len(f) == m // 2 + 1


def test_signals_of_unlike_lengths_and_rates_in_one_batch(spark):
    r = np.random.default_rng(3)
    rows = [("c", "x", s, float(fs), m, m / fs, r.normal(size=m).tolist()) for s, (m, fs) in enumerate([(64, 50.0), (65, 50.0), (64, 70.0), (10, 3.0), (64, 50.0)])]
    df = spark.createDataFrame(rows, "capture_id string, axis string, session_id int, fs double, samples long, duration double, signal array<double>").coalesce(1)
    for got, one in ((spectral.welch(df, 32, 16), lambda x, fs: spectral.welch_psd(x, fs, 32, 16)), (spectral.fft(df), spectral.whole_fft), (spectral.average_fft(df, 32, 16), lambda x, fs: spectral.mean_fft(x, fs, 32, 16))):
        of = {}
        for g in got.orderBy("session_id", "bin").collect():
            of.setdefault(g[2], []).append((g[4], g[5]))
        for _, _, s, fs, *_, x in rows:
            f, v = one(np.array(x), fs)
            assert np.allclose(of[s], np.column_stack((f, v)), rtol=1e-12, atol=1e-15)


BAND = Band("a", 0.0, 6.0, 0.0, 0.0, 0.0, 0.25, 2.0, 0.0)


def spectra(spark, change=None, axes="xyz"):
    shape = [1.0, 2.0, 1.0, 5.0, 1.0, 2.0, 1.5]
    rows = [["c", a, s, b, float(b), p + 0.01 * s] for a in axes for s in (1, 2, 3) for b, p in enumerate(shape)]
    for k, place, value in change or ():
        rows[k][place] = value
    return spark.createDataFrame([tuple(r) for r in rows], PSD)


@pytest.mark.parametrize(
    ("change", "text"),
    [
        ([(2, 4, 1.0)], "must rise"), ([(2, 4, math.nan)], "not finite"), ([(2, 4, None)], "missing"), ([(3, 5, -1.0)], "negative"),
        ([(3, 5, math.inf)], "not finite"), ([(3, 5, None)], "missing"), ([(3, 4, 2.5)], "share their frequencies"),
        ([(k, 4, 100.0 + k) for k in range(7)] + [(21 + k, 4, 100.0 + k) for k in range(7)] + [(42 + k, 4, 100.0 + k) for k in range(7)], "no range"),
    ],
)
def test_alignment_refuses(spark, change, text):
    with pytest.raises(Exception, match=text):
        align.align(spectra(spark, change)).collect()


def test_alignment_refuses_few_bins_and_uneven_axes(spark):
    one = spectra(spark).where("bin = 0")
    with pytest.raises(Exception, match="fewer than two frequencies"):
        align.align(one).collect()
    uneven = spectra(spark).where("not (axis = 'z' and session_id = 3)")
    assert align.align(uneven).count() == 8 * 7
    with pytest.raises(Exception, match="same number of sessions"):
        align.align(uneven, equal_axes=True).collect()
    with pytest.raises(Exception, match="gives the grid"):
        align.align(spectra(spark), axis="w").collect()


def test_peaks_and_views_refuse(spark):
    aligned, bands = spectra(spark), bands_table(spark, (BAND,))
    stats = align.bin_stats(aligned)
    found = peaks.find_peaks(stats, aligned, bands)
    assert sorted({r.bin for r in found.collect()}) == [1, 3, 5]
    with pytest.raises(ValueError, match="one analysis band"):
        peaks.find_peaks(stats, aligned, bands.where("band_ix > 5"))
    for value in ("-1.0D", "double('nan')", "double('inf')", "double(null)"):
        with pytest.raises(Exception, match="not finite or negative|is missing"):
            peaks.find_peaks(stats.withColumn("median", F.expr(f"if(bin = 3, {value}, median)")), aligned, bands).collect()
        with pytest.raises(Exception, match="not finite or negative|is missing"):
            align.background(stats.withColumn("median", F.expr(f"if(bin = 3, {value}, median)")), bands).collect()
    with pytest.raises(Exception, match="same bins"):
        peaks.find_peaks(stats, aligned.where("bin < 1"), bands).collect()
    with pytest.raises(Exception, match="same sessions"):
        peaks.find_peaks(stats, aligned.where("session_id < 3"), bands).collect()
    with pytest.raises(Exception, match="not finite or negative"):
        peaks.find_peaks(stats, spectra(spark, [(3, 5, -1.0)]), bands).collect()
    centres = stats.withColumns({"min_frequency": F.lit(2.0), "max_frequency": F.lit(4.0), "noise_window_hz": F.lit(2.0), "frequency_tolerance_hz": F.lit(0.5)})
    with pytest.raises(Exception, match="outside its band"):
        align.noise_floor(centres, stats, ["capture_id", "axis", "bin"]).collect()
    with pytest.raises(Exception, match="wider than"):
        align.noise_floor(centres.where("bin = 3").withColumn("noise_window_hz", F.lit(0.5)), stats, ["capture_id", "axis", "bin"]).collect()
    with pytest.raises(Exception, match="background is not finite"):
        spark.range(1).select(align.contrast(F.lit(1.0), F.lit(-2.0))).collect()
    none = spark.range(1).select(align.contrast(F.lit(1.0), F.expr("double('nan')")), align.contrast(F.lit(1.0), F.expr("double(null)")), align.contrast(F.lit(100.0), F.lit(1.0)))
    assert tuple(none.first()) == (None, None, 20.0)
    for make in (view.spectrum_view, view.assembled_view):
        assert make(stats, found, bands).where("is_peak").count() == 9
        with pytest.raises(Exception, match="exactly one bin"):
            make(stats, found.withColumn("bin", F.col("bin") + 50), bands).collect()
        with pytest.raises(Exception, match="bin's frequency"):
            make(stats, found.withColumn("frequency", F.col("frequency") + 0.5), bands).collect()
    with pytest.raises(Exception, match="lacks a diagnostic"):
        view.assembled_view(stats, found.withColumn("local_snr_db", F.lit(None).cast("double")), bands).collect()


def test_one_session_alone(spark):
    """Its deviation is zero, so its stability is, and no peak is stable enough."""
    aligned = align.align(spectra(spark).where("session_id = 1"))
    stats = align.bin_stats(aligned)
    assert all((r.sessions, r.std, r.stability, r.median) == (1, 0.0, 0.0, r.mean) for r in stats.collect())
    band = Band("a", 0.0, 6.0, 0.0, 0.0, 0.1, 0.25, 2.0, 0.0)
    assert peaks.find_peaks(stats, aligned, bands_table(spark, (band,))).collect() == []


def test_bands_as_an_axis_shows_them(spark):
    stats = align.bin_stats(spectra(spark, axes="x").withColumn("freq", F.col("freq") + 0.3))
    bands = bands_table(spark, (BAND, Band("b", 2.0, 3.9, 0.0, 0.0, 0.0, 0.25, 2.0, 0.0), Band("none", 80.0, 90.0, 0.0, 0.0, 0.0, 0.25, 2.0, 0.0)))
    own = view.bands_on_grid(stats, bands)
    assert sorted((r.name, r.min_frequency, r.max_frequency) for r in own.collect()) == [("a", 0.3, 5.3), ("b", 2.3, 3.3)]
    assert [r.edge for r in view.band_edges(own).collect()] == [0.3, 2.3, 3.3, 5.3] and [r.edge for r in view.band_edges(bands).collect()] == [0.0, 2.0, 3.9, 6.0, 80.0, 90.0]
    assert tuple(view.band_limits(own).first())[2:] == (0.3, 5.3) and tuple(view.band_limits(bands).first()) == (0.0, 90.0)
    assert {r.name: r.position for r in view.band_labels(own).collect()} == {"a": pytest.approx(2.8), "b": pytest.approx(2.8)}
