"""Operators against hand-worked values and small numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.config import Band, ConfigError, Settings, bands_table, check, limits, load
from tremor.operators import align, peaks, sessions, spectral, view
from tremor.sources import wire

BAND = Band("b", 0.0, 10.0, 0.0, 0.0, 0.0, 0.25, 2.0, 0.0)


def stats_of(spark, values, axis="x", freq=None):
    rows = [("c", axis, i, float(freq[i] if freq else i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "capture_id string, axis string, bin int, freq double, median double")


def test_windows_and_density():
    x = np.random.default_rng(0).normal(size=65)
    for m in (64, 65):
        f, p = spectral.welch_psd(x[:m], 50.0, m, 0)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
        y = (x[:m] - x[:m].mean()) * w
        assert math.isclose(p.sum() * 50.0 / m, (y * y).sum() / (w * w).sum(), rel_tol=1e-9)  # Parseval
        assert len(f) == m // 2 + 1 and math.isclose(f[1], 50.0 / m)
    tone = np.sin(2 * np.pi * 8 * np.arange(256) / 64)
    f, a = spectral.mean_fft(tone, 64.0, 64, 32)
    assert f[a.argmax()] == 8 and abs(a.max() - 1) < 0.02
    assert spectral.whole_fft(np.ones(1), 1.0)[1][0] == 2.0


def test_sessions(spark):
    rows = [("c", a, i, 10.0 + i, [float(i), float(i) + 1]) for a in "xyz" for i in range(11)]
    s = sessions.assign_sessions(spark.createDataFrame(rows, "capture_id string, axis string, arrival_ix long, fs double, values array<double>").orderBy(F.rand(1)), 4)
    out = sorted(map(tuple, sessions.signals(s).collect()))
    assert [r[:6] for r in out[:2]] == [("c", "x", 1, 11.5, 8, 8 / 11.5), ("c", "x", 2, 15.5, 8, 8 / 15.5)] and len(out) == 6
    assert out[0][6] == [v - 2.0 for v in (0, 1, 1, 2, 2, 3, 3, 4)]


def test_rates_do_not_depend_on_how_packets_are_dealt(spark):
    rates = [64 * (1 + k / 1000) for k in range(8)]
    turn = {"x": range(8), "y": range(7, -1, -1), "z": (3, 0, 7, 5, 1, 6, 2, 4)}
    rows = [("c", a, 1, i, rates[i], [float(i)]) for a in "xyz" for i in turn[a]] + [("c", "w", 1, 0, 2.0, [1.0]), ("c", "w", 1, 1, None, [1.0]), ("c", "v", 1, 0, None, [1.0])]
    s = spark.createDataFrame(rows, "capture_id string, axis string, session_id int, arrival_ix long, fs double, values array<double>")
    seen = {(r.axis, r.fs) for parts in (1, 5, 24) for d in (s.repartition(parts), s.coalesce(1)) for r in sessions.signals(d).collect()}
    assert len({f for a, f in seen if a in "xyz"}) == 1 and {("w", 2.0), ("v", None)} < seen

def test_bin_stats_and_alignment(spark):
    rows = [("c", "x", s, i, float(i), v) for s, v in enumerate((1.0, 2.0, 3.0, 10.0)) for i in range(2)]
    r = align.bin_stats(spark.createDataFrame(rows, "capture_id string, axis string, session_id int, bin int, freq double, psd double")).first()
    assert (r.median, r.mean) == (2.5, 4.0) and math.isclose(r.std, math.sqrt(12.5)) and math.isclose(r.stability, 4 / math.sqrt(12.5))
    one = [("c", "x", 1, f, p) for f, p in ((1.0, 9.0), (3.0, 8.0))] + [("c", "x", 2, f, p) for f, p in ((0.0, 0.0), (2.0, 2.0), (4.0, 6.0))]
    psd = spark.createDataFrame(one, "capture_id string, axis string, session_id int, freq double, psd double")
    got = {(r.session_id, r.bin): r.psd for r in align.align(align.check_psd(psd)).collect()}
    assert got == {(1, 0): 9.0, (1, 1): 8.0, (2, 0): 1.0, (2, 1): 4.0}
    for bad in ([("c", "x", 1, 1.0, 1.0)], [("c", "x", 1, 1.0, -1.0), ("c", "x", 1, 2.0, 1.0)], [("c", "x", 1, 1.0, 1.0), ("c", "x", 1, 1.0, 1.0)], []):
        with pytest.raises(ValueError):
            align.check_psd(spark.createDataFrame(bad, psd.schema))


def test_noise_floor(spark):
    bands = bands_table(spark, (BAND,))
    stats = stats_of(spark, [1, 2, 3, 4, 50, 100, 7, 8, 9, 1, 1])
    got = {r.bin: r.local_psd_background for r in align.background(stats, bands).collect()}
    assert got[5] == np.median([4, 50, 7, 8]) and got[0] is None and got[1] == np.median([1, 3, 4])


def test_maxima_distance_prominence(spark):
    bands = bands_table(spark, (Band("b", 0.0, 100.0, 0.0, 3.0, 0.0, 0.25, 2.0, 0.0),))

    def shape(values):
        s = stats_of(spark, [10 ** (v / 10) for v in values])
        return peaks.band_slices(s, bands), s

    slices, _ = shape([0, 1, 1, 1, 0, 1, 1, 0])
    assert sorted(r.bin for r in peaks.local_maxima(slices).collect()) == [2, 5]
    values = [0.0] * 35
    values[10], values[12], values[14], values[30] = 5, 7, 6, 1
    slices, stats = shape(values)
    assert sorted(r.bin for r in peaks.spaced(peaks.local_maxima(slices), stats, bands).collect()) == [12, 30]
    slices, _ = shape([0, 3, 1, 2, 0])
    got = {r.bin: (round(r.prominence, 9), r.left_base, r.right_base) for r in peaks.prominences(peaks.local_maxima(slices), slices).collect()}
    assert got == {1: (3.0, 0, 4), 3: (1.0, 2, 4)}


def test_window_power(spark):
    freq, psd = (0.0, 1.0, 2.0, 4.0), (2.0, 3.0, 5.0, 7.0)
    aligned = spark.createDataFrame([("c", "x", 1, i, f, p) for i, (f, p) in enumerate(zip(freq, psd, strict=True))], "capture_id string, axis string, session_id int, bin int, freq double, psd double")

    def power(centre, tol):
        c = spark.createDataFrame([("c", "x", 0, 0, centre, tol)], "capture_id string, axis string, band_ix int, bin int, freq double, frequency_tolerance_hz double")
        r = peaks.session_windows(c, aligned).first()
        return r.window_power, r.peak_frequency

    assert [power(2.0, 0.1), power(0.0, 0.1), power(4.0, 0.1), power(1.5, 0.5)] == [(7.5, 2.0), (2.0, 0.0), (14.0, 4.0), (4.0, 2.0)]


def test_tones_end_to_end(spark):
    r, n, per = np.random.default_rng(1), 128, 8
    rows = []
    for k in range(6 * per + 3):
        t = (k * n + np.arange(n)) / 64.0
        rows.append(("cap", k, 64.0, *((a * np.sin(2 * np.pi * 3 * t) + a * np.sin(2 * np.pi * 12 * t) + 0.3 * r.normal(size=n)).tolist() for a in (1, 2, 3))))
    packets = spark.createDataFrame(rows, "capture_id string, arrival_ix long, fs double, x array<double>, y array<double>, z array<double>")
    settings = (Band("low", 0.5, 10.0, 3.0, 1.0, 2.0, 0.25, 2.0, 6.0), Band("high", 10.0, 15.0, 3.0, 1.0, 2.0, 0.25, 2.0, 6.0))
    signal = sessions.signals(sessions.assign_sessions(sessions.by_axis(packets), per))
    aligned = align.align(spectral.welch(signal, 512, 256, *limits(settings)), "x").cache()
    stats, bands = align.bin_stats(aligned).cache(), bands_table(spark, settings)
    found = peaks.find_peaks(stats, aligned, bands)
    got = found.collect()
    for axis in "xyz":
        assert sorted(p.frequency for p in got if p.axis == axis) == [3.0, 12.0]
    seen = view.spectrum_view(stats, found, bands)
    assert seen.count() == stats.count() and seen.where("is_peak").count() == 6
    assert "Hz" in view.peak_labels(found).first().label


def test_frames(spark, tmp_path):
    good = wire.encode(range(5), range(5), [-7] * 5, 4000)
    (_, p), = wire.frames(b"junk" + good)
    assert p[3] == 1000.0 and p[6][0] == -2.734375e-05
    assert not list(wire.frames(b"V" + good)) and len(list(wire.frames(b"V" + good, "search"))) == 1
    assert len(list(wire.frames(good + good[:-1]))) == 1 and list(wire.frames(wire.encode([1], [1], [1], 5)))[0][1] is None
    (tmp_path / "a.bin").write_bytes(good * 3 + b"xx" + good)
    assert wire.read_captures(spark, str(tmp_path)).count() == 4


def test_stream_gives_the_same_sessions(spark, tmp_path):
    from tremor.streaming.sessions import session_packets

    data = b"".join(wire.encode([k] * 4, [k] * 4, [k] * 4, 1000, k) for k in range(13))
    (tmp_path / "cap").write_bytes(data)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(wire.CaptureSource)

    def go():
        stream = spark.readStream.format("vib2").option("path", str(tmp_path / "cap")).load()
        q = session_packets(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    go()
    got = sorted((r.session_id, r.arrival_ix) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(k // 4 + 1, k) for k in range(12)]


def test_config(tmp_path):
    text = """
[serial]
port = "COM1"
baud = 9600
timeout_seconds = 1
[session]
packets_per_session = 8
min_recommended_sessions = 5
[welch]
nperseg = 64
noverlap = 32
[[analysis.bands]]
name = "a"
min_frequency = 1
max_frequency = 9.5
prominence_db = 1
min_distance_hz = 1
min_stability = 1
frequency_tolerance_hz = 0.2
noise_window_hz = 1
min_snr_db = 3
"""
    path = tmp_path / "c.toml"
    path.write_text(text)
    s = load(path)
    assert isinstance(s, Settings) and limits(s.bands) == (1, 9.5)
    changes = (("noverlap = 32", "noverlap = 64"), ("baud = 9600", "baud = true"), ("noise_window_hz = 1", "noise_window_hz = 0.2"), ("min_frequency = 1", "min_frequency = nan"), ('name = "a"', 'name = " "'), ("nperseg = 64", ""), ("[welch]", "[welch"))
    for old, new in changes:
        path.write_text(text.replace(old, new, 1))
        with pytest.raises(ConfigError):
            load(path)
    with pytest.raises(ConfigError):
        load(tmp_path / "none.toml")
    with pytest.raises(ValueError):
        check(Settings("p", 1, 0, 1, 1, 2, 1, ()))
