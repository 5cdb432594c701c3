"""Queries over the driver's tables, and the same in SQL.

events is a signal of one axis for each event_type, in order of ts and event_id; 16 values
are a packet, 8 packets a session, and the sampling rate is NPERSEG, so bins are whole Hz.
Bands share an edge.  Computed doubles are rounded, the median before peaks are sought.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.config import Band, bands_table, limits
from tremor.operators import align, peaks, sessions, spectral, view
from tremor.operators.order import Ordered
from tremor.sources import wire
from tremor.storage import shared_dir, written

PACKET, PACKETS, NPERSEG, NOVERLAP = 16, 8, 64, 32
BANDS = (
    Band("low", 1.0, 16.0, 0.1, 2.0, 0.5, 1.0, 5.0, 0.0),
    Band("high", 16.0, 31.0, 0.2, 1.0, 0.6, 0.5, 4.0, 0.5),
    Band("middle", 10.0, 20.0, 0.1, 3.0, 0.5, 1.0, 6.0, 0.0),
)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    placed = Ordered(events, ["event_type"], ["ts", "event_id"]).placed("g").groupBy(F.col("event_type").alias("axis"), F.floor(F.col("g") / PACKET).alias("arrival_ix"))
    ordered = placed.agg(F.array_sort(F.collect_list(F.struct("g", "value"))).alias("rows"))
    return ordered.where(F.size("rows") == PACKET).select(
        F.lit("events").alias("capture_id"), "axis", "arrival_ix", F.lit(float(NPERSEG)).alias("fs"), F.transform("rows", lambda r: r["value"]).alias("values")
    )


#: Packets of a capture file, bytes of a range when it is read, and what stands between its frames.
CAPTURE, RANGE, JUNK = 64, 5000, b"noise V..."


def _captures(packets: DataFrame) -> str:
    """The folder of capture files of the packets: counts of x, minus x and twice x.

    After some packets a malformed frame or bytes of no frame follow, and each file ends in a cut frame."""
    root = shared_dir(packets.sparkSession)
    store, folder = wire._store(root)
    store.create_dir(folder)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name, out = f"{pdf['axis'].iloc[0]}-{pdf['chunk'].iloc[0]}", []
        for arrival, values in pdf.sort_values("arrival_ix")[["arrival_ix", "values"]].itertuples(index=False, name=None):
            x = np.rint(np.asarray(values) * 100).astype(np.int64)
            frame = wire.encode(x, -x, 2 * x, ELAPSED, arrival)
            idle = {3: wire.encode([1], [1], [1], 5), 5: wire.encode(x, x, x, 0), 7: JUNK}
            out += [frame, idle.get(arrival % 10, b"")]
        store, folder = wire._store(root)
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(b"".join(out) + frame[:-5])
        return pd.DataFrame({"capture": [name], "packets": [len(pdf)]})

    chunked = packets.select("axis", F.floor(F.col("arrival_ix") / CAPTURE).alias("chunk"), "arrival_ix", "values")
    written(chunked.groupBy("axis", "chunk").applyInPandas(write, "capture string, packets long"), "captures")
    return root


#: Microseconds of a packet of PACKET samples at NPERSEG a second.
ELAPSED = (PACKET - 1) * 1_000_000 // NPERSEG


def _captured_packets(r: _Run) -> DataFrame:
    sums = [F.round(F.aggregate(a, F.lit(0.0), lambda t, v: t + v), 12).alias(f"{a}_sum") for a in "xyz"]
    return wire.read_captures(r.spark, _captures(r.packets), range_bytes=RANGE).select("capture_id", "arrival_ix", "n", "elapsed_us", "sequence", F.round("fs", 9).alias("fs"), *sums)


def _captured_rest(r: _Run) -> DataFrame:
    return wire.quarantine(r.spark, _captures(r.packets), range_bytes=RANGE).groupBy("capture_id", "reason").agg(F.sum("length").alias("bytes"))


class _Run:
    """The stages over one folder of tables; those that others read several times are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.bands = bands_table(spark, BANDS)

    @cached_property
    def packets(self) -> DataFrame:
        return _packets(self.spark, self.dir)

    @cached_property
    def session_packets(self) -> DataFrame:
        return sessions.assign_sessions(self.packets, PACKETS, numbered=True)

    @cached_property
    def signals(self) -> DataFrame:
        return sessions.signals(self.session_packets)

    @cached_property
    def psd(self) -> DataFrame:
        return spectral.welch(self.signals, NPERSEG, NOVERLAP, *limits(BANDS))

    @cached_property
    def aligned(self) -> DataFrame:
        # sessions are counted axis by axis here, so each axis is a capture of its own grid
        return self.psd.select("capture_id", "axis", "session_id", (F.col("bin") - 1).alias("bin"), "freq", F.round("psd", 9).alias("psd"))

    @cached_property
    def stats(self) -> DataFrame:
        return written(align.bin_stats(self.aligned).withColumn("median", F.round("median", 6)), "stats")

    @cached_property
    def grid_bands(self) -> DataFrame:
        return view.bands_on_grid(self.stats, self.bands)

    @cached_property
    def slices(self) -> DataFrame:
        return peaks.band_slices(self.stats, self.bands)

    @cached_property
    def spaced(self) -> DataFrame:
        return peaks.spaced(peaks.local_maxima(self.slices), self.stats, self.bands)

    @cached_property
    def prominences(self) -> DataFrame:
        return peaks.prominences(self.spaced, self.slices)

    @cached_property
    def centres(self) -> DataFrame:
        freq = self.stats.select("capture_id", "axis", "bin", "freq", F.col("median").alias("amplitude"))
        return self.prominences.join(F.broadcast(self.bands), "band_ix").join(freq, ["capture_id", "axis", "bin"])

    @cached_property
    def found(self) -> DataFrame:
        return peaks.find_peaks(self.stats, self.aligned, self.bands)


class _Uneven(_Run):
    """Packets whose sampling rate changes from one to the next, so sessions have rates of their own
    and their spectra have to be put on one grid, that of the first session of the first axis."""

    @cached_property
    def packets(self) -> DataFrame:
        session, turn = F.floor(F.col("arrival_ix") / PACKETS), F.col("arrival_ix") % PACKETS
        return super().packets.withColumn("fs", NPERSEG * (1 + session % 3 / 100 + turn / 1000))

    @cached_property
    def aligned(self) -> DataFrame:
        return align.align(self.psd).withColumn("psd", F.round("psd", 9)).withColumn("freq", F.round("freq", 9))


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _hann(r: _Run, periodic: bool) -> DataFrame:
    """A window over the first segment of each session's signal, its sum and the sum of the signal under it."""
    first = sessions.samples(r.signals).where(F.col("i") < NPERSEG).withColumn("w", spectral.hann(F.col("i"), NPERSEG, periodic))
    of_session = W.partitionBy(*sessions.KEY)
    sums = {"total": F.sum("w").over(of_session), "windowed_sum": F.sum(F.col("value") * F.col("w")).over(of_session)}
    return first.withColumns(sums).select("axis", "session_id", "i", *_r("w", "total", digits=9), *_r("windowed_sum"))


def _embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a stack of spectra: label is the axis, vec_id the session, the place the bin."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null")
    rows = e.select(F.lit("e").alias("capture_id"), F.col("label").cast("string").alias("axis"), F.col("vec_id").alias("session_id"), F.posexplode("embedding").alias("bin", "v"))
    psd = rows.withColumn("psd", F.col("v").cast("double") * F.col("v").cast("double")).withColumn("freq", F.col("bin").cast("double"))
    return align.bin_stats(psd).select("axis", "bin", "sessions", *_r("median", "mean", "std", "stability", digits=9))


def _jittered(r: _Run) -> DataFrame:
    """Spectra whose sessions differ in sampling rate, so alignment has to interpolate."""
    shift = F.col("freq") * (1 + F.col("session_id") % 3 / 100)
    return align.align(r.psd.withColumn("freq", shift)).select("axis", "session_id", "bin", *_r("freq", "psd"))


def queries() -> dict:
    one = lambda f: lambda spark, d: f(_Run(spark, d))
    uneven = lambda f: lambda spark, d: f(_Uneven(spark, d))
    return {
        "captured_packets": one(_captured_packets),
        "captured_rest": one(_captured_rest),
        "uneven_sessions": uneven(lambda r: r.signals.select("axis", "session_id", *_r("fs", "duration", digits=9), "samples")),
        "uneven_stats": uneven(lambda r: r.stats.select("axis", "bin", *_r("freq"), "sessions", "median", *_r("mean", "std", "stability", digits=5))),
        "uneven_peaks": uneven(lambda r: r.found.select("axis", "bin", "band_ix", *_r("frequency"), "amplitude", *_r("window_power_stability", "local_snr_db", "prominence", "mean_session_frequency", digits=5))),
        "one_session_stats": one(lambda r: align.bin_stats(r.aligned.where("session_id = 1")).select("axis", "bin", "freq", "sessions", *_r("median", "mean"), "std", "stability")),
        "session_windows": one(lambda r: r.session_packets.groupBy("axis", "session_id").agg(F.min("arrival_ix").alias("first_packet"), F.count("*").alias("packets"))),
        "session_signals": one(lambda r: r.signals.select("axis", "session_id", "fs", "samples", "duration")),
        "packet_progress": one(lambda r: sessions.progress(r.packets).select("axis", "arrival_ix", "packets", "mean_fs", "duration")),
        "recommended_sessions": one(lambda r: sessions.enough_sessions(r.session_packets, 5).select("axis", "sessions", "recommended")),
        "demean": one(lambda r: sessions.samples(r.signals).select("axis", "session_id", "i", *_r("value", digits=10))),
        "hann_symmetric": one(lambda r: _hann(r, False)),
        "hann_periodic": one(lambda r: _hann(r, True)),
        "fft_amplitude": one(lambda r: spectral.fft(r.signals).select("axis", "session_id", "bin", *_r("freq", "amplitude"))),
        "average_fft": one(lambda r: spectral.average_fft(r.signals, NPERSEG, NOVERLAP).select("axis", "session_id", "bin", *_r("freq", "amplitude"))),
        "welch_psd": one(lambda r: r.psd.select("axis", "session_id", "bin", *_r("freq", "psd"))),
        "resolutions": one(lambda r: spectral.resolutions(r.signals, NPERSEG).select("axis", "session_id", "fft_resolution", "psd_resolution")),
        "band_limits": one(lambda r: view.band_limits(r.grid_bands).drop("capture_id")),
        "band_edges": one(lambda r: view.band_edges(r.grid_bands).drop("capture_id")),
        "band_labels": one(lambda r: view.band_labels(r.grid_bands).drop("capture_id")),
        "band_assign_all": one(lambda r: align.in_bands(r.stats, r.bands).select("axis", "bin", "band_ix", "freq")),
        "band_assign_first": one(lambda r: align.first_band(r.stats, r.bands).select("axis", "bin", "band_ix", "freq")),
        "common_range": one(lambda r: align.common_range(r.psd).select("low", "high")),
        "interp_align": one(_jittered),
        "bin_stats": one(lambda r: r.stats.select("axis", "bin", "freq", "sessions", "median", *_r("mean", "std", "stability", digits=5))),
        "bin_stats_embeddings": _embedding_stats,
        "noise_floor": one(lambda r: align.background(r.stats, r.bands).select("axis", "bin", *_r("local_psd_background", digits=8))),
        "local_contrast": one(lambda r: align.background(r.stats, r.bands).select("axis", "bin", *_r("local_psd_contrast_db", digits=5))),
        "local_maxima": one(lambda r: peaks.local_maxima(r.slices).select("axis", "band_ix", "bin", *_r("db", digits=5))),
        "nms_distance": one(lambda r: r.spaced.select("axis", "band_ix", "bin")),
        "prominence": one(lambda r: r.prominences.select("axis", "band_ix", "bin", *_r("prominence", digits=5), "left_base", "right_base")),
        "window_power": one(lambda r: peaks.session_windows(r.centres, r.aligned).select("axis", "band_ix", "bin", "session_id", *_r("window_power", digits=5))),
        "session_argmax": one(lambda r: peaks.session_windows(r.centres, r.aligned).select("axis", "band_ix", "bin", "session_id", "peak_frequency")),
        "peak_diagnostics": one(
            lambda r: peaks.diagnostics(peaks.session_windows(r.centres, r.aligned)).select(
                "axis", "band_ix", "bin", *_r("window_power_stability", "mean_session_frequency", "frequency_std_hz", "minimum_session_frequency", "maximum_session_frequency", digits=5)
            )
        ),
        "peaks_dedup": one(lambda r: r.found.select("axis", "bin", "band_ix", "frequency", "amplitude", *_r("window_power_stability", "local_snr_db", "prominence", digits=5))),
        "peak_labels": one(lambda r: view.peak_labels(r.found).select("axis", "bin", "label")),
        "spectrum_view": one(lambda r: view.spectrum_view(r.stats, r.found, r.bands).select("axis", "bin", "freq", "median", *_r("stability", "local_psd_contrast_db", digits=5), "is_peak")),
        "peaks_ordered": one(lambda r: peaks.ordered(r.found).select("axis", "place", "bin", "frequency")),
        "assembled_view": one(
            lambda r: view.assembled_view(r.stats, r.found, r.bands).select(
                "axis", "bin", "freq", "median", "first_band", "min_stability", "min_snr_db", "peak_band", *_r("window_power_stability", "frequency_std_hz", "local_snr_db", "prominence", digits=5), "left_base", "right_base", "is_peak"
            )
        ),
    }


_L, _HOP, _SEGMENTS = PACKET * PACKETS, NPERSEG - NOVERLAP, (PACKET * PACKETS - NPERSEG) // (NPERSEG - NOVERLAP) + 1
_BANDS = ", ".join(
    f"({i}, '{b.name}', {b.min_frequency!r}::DOUBLE, {b.max_frequency!r}::DOUBLE, {b.prominence_db!r}::DOUBLE, {b.min_distance_hz!r}::DOUBLE, {b.min_stability!r}::DOUBLE, "
    f"{b.frequency_tolerance_hz!r}::DOUBLE, {b.noise_window_hz!r}::DOUBLE, {b.min_snr_db!r}::DOUBLE)"
    for i, b in enumerate(BANDS)
)
_TINY = "2.2250738585072014e-308"
#: Named parts; each may use those before it.
PARTS = {
    "bands": f"bands(band_ix, name, lo, hi, prom, dist, stab, tol, noise, snr) AS (VALUES {_BANDS})",
    "ev": "ev AS (SELECT event_type AS axis, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS g FROM events)",
    "pk": f"pk AS (SELECT axis, g // {PACKET} AS arrival_ix, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) = {PACKET})",
    "smp": f"smp AS (SELECT axis, g // {_L} + 1 AS session_id, g % {_L} AS i, value FROM ev QUALIFY count(*) OVER (PARTITION BY axis, g // {_L}) = {_L})",
    "dem": "dem AS (SELECT axis, session_id, i, value - avg(value) OVER (PARTITION BY axis, session_id) AS v FROM smp)",
    "seg": f"seg AS (SELECT axis, session_id, s, i - s * {_HOP} AS j, v, v - avg(v) OVER (PARTITION BY axis, session_id, s) AS d FROM dem, "
    f"(SELECT unnest(range({_SEGMENTS})) AS s) t WHERE i >= s * {_HOP} AND i < s * {_HOP} + {NPERSEG})",
    "psd": f"""psd AS MATERIALIZED (SELECT axis, session_id, CAST(k AS INTEGER) AS bin, CAST(k AS DOUBLE) AS freq, avg(p) AS psd FROM (
  SELECT axis, session_id, s, k, CASE WHEN k = 0 OR k = {NPERSEG // 2} THEN 1 ELSE 2 END
    * (pow(sum(d * w * cos(2 * pi() * k * j / {NPERSEG})), 2) + pow(sum(d * w * sin(2 * pi() * k * j / {NPERSEG})), 2)) / ({NPERSEG} * {NPERSEG} * 0.375) AS p
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {NPERSEG}) AS w FROM seg) a, (SELECT unnest(range(1, 32)) AS k) b GROUP BY axis, session_id, s, k) c GROUP BY axis, session_id, k)""",
    "aligned": "aligned AS MATERIALIZED (SELECT axis, session_id, bin - 1 AS bin, freq, round(psd, 9) AS psd FROM psd)",
    "stats": "stats AS MATERIALIZED (SELECT axis, bin, any_value(freq) AS freq, count(*) AS sessions, round(median(psd), 6) AS median, avg(psd) AS mean, stddev_pop(psd) AS std FROM aligned GROUP BY axis, bin)",
    "stat2": "stat2 AS (SELECT *, CASE WHEN std <> 0 THEN mean / std ELSE 0.0 END AS stability FROM stats)",
    "inb": "inb AS MATERIALIZED (SELECT s.*, b.* FROM stats s JOIN bands b ON s.freq BETWEEN b.lo AND b.hi)",
    "firstb": "firstb AS (SELECT * FROM inb QUALIFY row_number() OVER (PARTITION BY axis, bin ORDER BY band_ix) = 1)",
    "bg": """bg AS (SELECT c.axis, c.bin, median(n.median) AS floor FROM firstb c JOIN stats n ON n.axis = c.axis
  AND n.freq BETWEEN greatest(c.freq - c.noise, c.lo) AND least(c.freq + c.noise, c.hi) AND NOT (n.freq BETWEEN c.freq - c.tol AND c.freq + c.tol)
  GROUP BY c.axis, c.bin HAVING count(*) >= 3)""",
    "contrast": f"""contrast AS (SELECT s.*, b.floor, 10 * log10(greatest(s.median, {_TINY})) - 10 * log10(CASE WHEN b.floor IS NOT NULL THEN greatest(b.floor, {_TINY}) END) AS db
  FROM stat2 s LEFT JOIN bg b USING (axis, bin))""",
    "sl": f"sl AS MATERIALIZED (SELECT axis, band_ix, bin, freq, median, 10 * log10(greatest(median, {_TINY})) AS db FROM inb QUALIFY count(*) OVER (PARTITION BY axis, band_ix) >= 2)",
    "runs": """runs AS (SELECT *, sum(ch) OVER (PARTITION BY axis, band_ix ORDER BY bin) AS run FROM (
  SELECT *, CASE WHEN lag(db) OVER (PARTITION BY axis, band_ix ORDER BY bin) = db THEN 0 ELSE 1 END AS ch FROM sl) a)""",
    "mx": """mx AS MATERIALIZED (SELECT axis, band_ix, CAST((a + e) // 2 AS INTEGER) AS bin, db FROM (
  SELECT *, lag(db) OVER w AS b4, lead(db) OVER w AS af FROM (SELECT axis, band_ix, run, min(bin) AS a, max(bin) AS e, any_value(db) AS db FROM runs GROUP BY axis, band_ix, run) r
  WINDOW w AS (PARTITION BY axis, band_ix ORDER BY run)) q WHERE b4 < db AND af < db)""",
    "res": "res AS (SELECT max(freq) FILTER (bin = 1) - max(freq) FILTER (bin = 0) AS r FROM stats)",
    "nms": """nms AS MATERIALIZED (SELECT axis, band_ix, unnest(kept) AS bin FROM (
  SELECT m.axis, m.band_ix, list_reduce(list(m.bin ORDER BY m.db DESC, m.bin DESC), lambda got, p:
    CASE WHEN len(list_filter(got, lambda q: abs(q - p) < any_value(greatest(floor(b.dist / r.r), 1)))) > 0 THEN got ELSE list_append(got, p) END, CAST([] AS INTEGER[])) AS kept
  FROM mx m JOIN bands b USING (band_ix), res r GROUP BY m.axis, m.band_ix) a)""",
    "prom": """prom AS MATERIALIZED (SELECT axis, band_ix, bin, db, db - greatest(lm, rm) AS prominence, left_base, right_base FROM (
  SELECT w.axis, w.band_ix, w.bin, w.db, min(s.db) FILTER (s.bin <= w.bin) AS lm, min(s.db) FILTER (s.bin >= w.bin) AS rm,
    arg_min(s.bin, row(s.db, abs(s.bin - w.bin))) FILTER (s.bin <= w.bin) AS left_base, arg_min(s.bin, row(s.db, abs(s.bin - w.bin))) FILTER (s.bin >= w.bin) AS right_base
  FROM (SELECT n.axis, n.band_ix, n.bin, m.db, max(s.bin) FILTER (s.bin < n.bin AND s.db > m.db) AS lw, min(s.bin) FILTER (s.bin > n.bin AND s.db > m.db) AS rw
        FROM nms n JOIN mx m USING (axis, band_ix, bin) JOIN sl s ON s.axis = n.axis AND s.band_ix = n.band_ix GROUP BY n.axis, n.band_ix, n.bin, m.db) w
  JOIN sl s ON s.axis = w.axis AND s.band_ix = w.band_ix AND (w.lw IS NULL OR s.bin > w.lw) AND (w.rw IS NULL OR s.bin < w.rw)
  GROUP BY w.axis, w.band_ix, w.bin, w.db) z)""",
    "cen": "cen AS MATERIALIZED (SELECT p.*, b.* EXCLUDE (band_ix), s.freq, s.median AS amplitude FROM prom p JOIN bands b USING (band_ix) JOIN stats s ON s.axis = p.axis AND s.bin = p.bin)",
    "win": """win AS MATERIALIZED (SELECT axis, band_ix, bin, session_id, CASE WHEN count(*) > 1 THEN sum(area) ELSE max(psd * width) END AS window_power, arg_max(f, row(psd, -f)) AS peak_frequency FROM (
  SELECT c.axis, c.band_ix, c.bin, a.session_id, a.freq AS f, a.psd, a.width,
    (a.psd + lead(a.psd) OVER v) / 2 * (lead(a.freq) OVER v - a.freq) AS area
  FROM cen c JOIN (SELECT *, CASE WHEN lag(freq) OVER u IS NULL THEN lead(freq) OVER u - freq WHEN lead(freq) OVER u IS NULL THEN freq - lag(freq) OVER u
    ELSE (lead(freq) OVER u - lag(freq) OVER u) / 2 END AS width FROM aligned WINDOW u AS (PARTITION BY axis, session_id ORDER BY bin)) a
  ON a.axis = c.axis AND a.freq BETWEEN c.freq - c.tol AND c.freq + c.tol WINDOW v AS (PARTITION BY c.axis, c.band_ix, c.bin, a.session_id ORDER BY a.bin)) x GROUP BY axis, band_ix, bin, session_id)""",
    "diag": """diag AS (SELECT axis, band_ix, bin, CASE WHEN stddev_pop(window_power) <> 0 THEN avg(window_power) / stddev_pop(window_power) ELSE 0.0 END AS window_power_stability,
  avg(peak_frequency) AS mean_session_frequency, stddev_pop(peak_frequency) AS frequency_std_hz, min(peak_frequency) AS minimum_session_frequency,
  max(peak_frequency) AS maximum_session_frequency FROM win GROUP BY axis, band_ix, bin)""",
    "fl": """fl AS (SELECT c.axis, c.band_ix, c.bin, median(n.median) AS floor FROM cen c JOIN stats n ON n.axis = c.axis
  AND n.freq BETWEEN greatest(c.freq - c.noise, c.lo) AND least(c.freq + c.noise, c.hi) AND NOT (n.freq BETWEEN c.freq - c.tol AND c.freq + c.tol)
  GROUP BY c.axis, c.band_ix, c.bin HAVING count(*) >= 3)""",
    "found": f"""found AS MATERIALIZED (SELECT c.axis, c.bin, c.band_ix, c.freq AS frequency, c.amplitude, d.window_power_stability, d.frequency_std_hz, c.prominence,
  10 * log10(greatest(c.amplitude, {_TINY})) - 10 * log10(greatest(f.floor, {_TINY})) AS local_snr_db
  FROM cen c JOIN diag d USING (axis, band_ix, bin) JOIN fl f USING (axis, band_ix, bin)
  WHERE c.prominence >= c.prom AND local_snr_db >= c.snr AND d.window_power_stability >= c.stab
  QUALIFY row_number() OVER (PARTITION BY c.axis, c.bin ORDER BY c.prominence DESC, c.band_ix) = 1)""",
}


#: The same parts over sessions of unequal rates.
_UNEVEN = {
    "rate": f"rate AS (SELECT axis, session_id, avg({NPERSEG} * (1 + (session_id - 1) % 3 / 100 + i // {PACKET} / 1000)) AS fs, count(*) AS samples FROM smp GROUP BY axis, session_id)",
    "jit": f"jit AS MATERIALIZED (SELECT p.axis, p.session_id, p.bin * r.fs / {NPERSEG} AS freq, p.psd * {NPERSEG} / r.fs AS psd FROM psd p JOIN rate r USING (axis, session_id) WHERE p.bin * r.fs / {NPERSEG} BETWEEN 1 AND 31)",
    "rng": "rng AS (SELECT max(a) AS lo, min(e) AS hi FROM (SELECT min(freq) AS a, max(freq) AS e FROM jit GROUP BY axis, session_id) t)",
    "grid": """grid AS (SELECT freq, row_number() OVER (ORDER BY freq) - 1 AS bin FROM jit, rng
  WHERE (axis, session_id) = (SELECT (axis, session_id) FROM jit ORDER BY axis, session_id LIMIT 1) AND freq BETWEEN lo AND hi)""",
    "br": "br AS (SELECT axis, session_id, freq AS f0, psd AS p0, lead(freq) OVER w AS f1, lead(psd) OVER w AS p1 FROM jit WINDOW w AS (PARTITION BY axis, session_id ORDER BY freq))",
    "aligned": """aligned AS MATERIALIZED (SELECT axis, session_id, CAST(bin AS INTEGER) AS bin, round(freq, 9) AS freq,
  round(CASE WHEN freq = f0 THEN p0 ELSE p0 + (p1 - p0) / (f1 - f0) * (freq - f0) END, 9) AS psd
  FROM br JOIN grid ON (freq >= f0 AND freq < f1) OR (f1 IS NULL AND freq = f0))""",
}


def _sql(select: str, uneven: bool = False) -> str:
    """WITH all parts that the select needs, directly or through others."""
    import re

    parts = {}
    for name, text in PARTS.items():
        parts |= _UNEVEN if uneven and name == "aligned" else {name: text}
    names = list(parts)
    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in need and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{n}\b", text):
                need.add(n)
                todo.append(parts[n])
    return "WITH " + ",\n".join(parts[n] for n in names if n in need) + "\n" + select if need else select


def _dft(window: str, size: int, source: str, by: str) -> str:
    return f"""SELECT axis, session_id{by}, k, 2 * sqrt(pow(sum(v * {window} * cos(2 * pi() * k * j / {size})), 2) + pow(sum(v * {window} * sin(2 * pi() * k * j / {size})), 2)) / ({size - 1} / 2.0) AS a
  FROM {source}, (SELECT unnest(range({size // 2 + 1})) AS k) b GROUP BY axis, session_id{by}, k"""


def oracle_sql() -> dict[str, str]:
    hann = lambda w: f"""SELECT axis, CAST(session_id AS INTEGER) AS session_id, CAST(i AS INTEGER) AS i, round({w}, 9) AS w,
  round(sum({w}) OVER (PARTITION BY axis, session_id), 9) AS total, round(sum(v * {w}) OVER (PARTITION BY axis, session_id), 6) AS windowed_sum FROM dem WHERE i < {NPERSEG}"""  # noqa: E731
    sym = lambda m, i: f"(0.5 - 0.5 * cos(2 * pi() * {i} / {m - 1}))"
    jitter = """, jit AS MATERIALIZED (SELECT axis, session_id, freq * (1 + session_id % 3 / 100) AS freq, psd FROM psd),
rng AS (SELECT max(a) AS lo, min(e) AS hi FROM (SELECT min(freq) AS a, max(freq) AS e FROM jit GROUP BY axis, session_id) t),
grid AS (SELECT freq, row_number() OVER (ORDER BY freq) - 1 AS bin FROM jit, rng
  WHERE (axis, session_id) = (SELECT (axis, session_id) FROM jit ORDER BY axis, session_id LIMIT 1) AND freq BETWEEN lo AND hi),
br AS (SELECT axis, session_id, freq AS f0, psd AS p0, lead(freq) OVER w AS f1, lead(psd) OVER w AS p1 FROM jit WINDOW w AS (PARTITION BY axis, session_id ORDER BY freq))
"""
    out = {
        "session_windows": f"SELECT axis, CAST(arrival_ix // {PACKETS} + 1 AS INTEGER) AS session_id, min(arrival_ix) AS first_packet, count(*) AS packets FROM pk GROUP BY axis, 2 HAVING count(*) = {PACKETS}",
        "session_signals": f"SELECT axis, CAST(session_id AS INTEGER) AS session_id, {NPERSEG}.0::DOUBLE AS fs, count(*) AS samples, count(*) / {NPERSEG}.0::DOUBLE AS duration FROM smp GROUP BY axis, session_id",
        "packet_progress": f"SELECT axis, arrival_ix, arrival_ix + 1 AS packets, {NPERSEG}.0::DOUBLE AS mean_fs, (arrival_ix + 1) * {PACKET} / {NPERSEG}.0::DOUBLE AS duration FROM pk",
        "recommended_sessions": f"SELECT axis, count(*) // {_L} AS sessions, count(*) // {_L} >= 5 AS recommended FROM ev GROUP BY axis HAVING count(*) >= {_L}",
        "demean": "SELECT axis, CAST(session_id AS INTEGER) AS session_id, CAST(i AS INTEGER) AS i, round(v, 10) AS value FROM dem",
        "hann_symmetric": hann(sym(NPERSEG, "i")),
        "hann_periodic": hann(f"(0.5 - 0.5 * cos(2 * pi() * i / {NPERSEG}))"),
        "fft_amplitude": f"SELECT axis, CAST(session_id AS INTEGER) AS session_id, CAST(k AS INTEGER) AS bin, round(k * {NPERSEG} / {_L}::DOUBLE, 6) AS freq, round(a, 6) AS amplitude FROM ("
        + _dft(sym(_L, "j"), _L, "(SELECT axis, session_id, i AS j, v FROM dem) d", "") + ") x",
        "average_fft": "SELECT axis, CAST(session_id AS INTEGER) AS session_id, CAST(k AS INTEGER) AS bin, CAST(k AS DOUBLE) AS freq, round(avg(a), 6) AS amplitude FROM ("
        + _dft(sym(NPERSEG, "j"), NPERSEG, "seg", ", s") + ") x GROUP BY axis, session_id, k",
        "welch_psd": "SELECT axis, CAST(session_id AS INTEGER) AS session_id, bin, freq, round(psd, 6) AS psd FROM psd",
        "resolutions": f"SELECT DISTINCT axis, CAST(session_id AS INTEGER) AS session_id, {NPERSEG / _L}::DOUBLE AS fft_resolution, 1.0::DOUBLE AS psd_resolution FROM smp",
        "band_limits": "SELECT axis, min(freq) AS low, max(freq) AS high FROM inb GROUP BY axis",
        "band_edges": "SELECT axis, min(freq) AS edge FROM inb GROUP BY axis, band_ix UNION SELECT axis, max(freq) FROM inb GROUP BY axis, band_ix",
        "band_labels": "SELECT axis, band_ix, name, (min(freq) + max(freq)) / 2 AS position FROM inb GROUP BY axis, band_ix, name",
        "band_assign_all": "SELECT axis, bin, band_ix, freq FROM inb",
        "band_assign_first": "SELECT axis, bin, band_ix, freq FROM firstb UNION ALL SELECT axis, bin, NULL, freq FROM stats WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE freq BETWEEN b.lo AND b.hi)",
        "common_range": "SELECT max(a) AS low, min(e) AS high FROM (SELECT min(freq) AS a, max(freq) AS e FROM psd GROUP BY axis, session_id) t",
        "interp_align": "FROM psd",
        "bin_stats": "SELECT axis, bin, freq, sessions, median, round(mean, 5) AS mean, round(std, 5) AS std, round(stability, 5) AS stability FROM stat2",
        "bin_stats_embeddings": """SELECT axis, bin, sessions, round(median, 9) AS median, round(mean, 9) AS mean, round(std, 9) AS std, round(CASE WHEN std <> 0 THEN mean / std ELSE 0.0 END, 9) AS stability
FROM (SELECT CAST(label AS VARCHAR) AS axis, bin, count(*) AS sessions, median(p) AS median, avg(p) AS mean, stddev_pop(p) AS std
      FROM (SELECT label, CAST(i - 1 AS INTEGER) AS bin, CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS p
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label IS NOT NULL) a) b GROUP BY label, bin) c""",
        "noise_floor": "SELECT s.axis, s.bin, round(b.floor, 8) AS local_psd_background FROM stats s LEFT JOIN bg b USING (axis, bin)",
        "local_contrast": "SELECT axis, bin, round(db, 5) AS local_psd_contrast_db FROM contrast",
        "local_maxima": "SELECT axis, band_ix, bin, round(db, 5) AS db FROM mx",
        "nms_distance": "SELECT axis, band_ix, bin FROM nms",
        "prominence": "SELECT axis, band_ix, bin, round(prominence, 5) AS prominence, left_base, right_base FROM prom",
        "window_power": "SELECT axis, band_ix, bin, CAST(session_id AS INTEGER) AS session_id, round(window_power, 5) AS window_power FROM win",
        "session_argmax": "SELECT axis, band_ix, bin, CAST(session_id AS INTEGER) AS session_id, peak_frequency FROM win",
        "peak_diagnostics": """SELECT axis, band_ix, bin, round(window_power_stability, 5) AS window_power_stability, round(mean_session_frequency, 5) AS mean_session_frequency,
  round(frequency_std_hz, 5) AS frequency_std_hz, minimum_session_frequency, maximum_session_frequency FROM diag""",
        "peaks_dedup": """SELECT axis, bin, band_ix, frequency, amplitude, round(window_power_stability, 5) AS window_power_stability,
  round(local_snr_db, 5) AS local_snr_db, round(prominence, 5) AS prominence FROM found""",
        "peak_labels": "SELECT axis, bin, printf('%.1f Hz\nσf %.2f Hz\nSNR %.1f dB', frequency, frequency_std_hz, local_snr_db) AS label FROM found",
        "spectrum_view": """SELECT c.axis, c.bin, c.freq, c.median, round(c.stability, 5) AS stability, round(c.db, 5) AS local_psd_contrast_db, f.bin IS NOT NULL AS is_peak
FROM contrast c LEFT JOIN found f ON f.axis = c.axis AND f.bin = c.bin""",
        "peaks_ordered": "SELECT axis, CAST(row_number() OVER (PARTITION BY axis ORDER BY bin) AS INTEGER) AS place, bin, frequency FROM found",
        "assembled_view": """SELECT c.axis, c.bin, c.freq, c.median, b.band_ix AS first_band, b.stab AS min_stability, b.snr AS min_snr_db, f.band_ix AS peak_band,
  round(f.window_power_stability, 5) AS window_power_stability, round(f.frequency_std_hz, 5) AS frequency_std_hz, round(f.local_snr_db, 5) AS local_snr_db,
  round(f.prominence, 5) AS prominence, p.left_base, p.right_base, f.bin IS NOT NULL AS is_peak
FROM contrast c LEFT JOIN firstb t ON t.axis = c.axis AND t.bin = c.bin LEFT JOIN bands b ON b.band_ix = t.band_ix
LEFT JOIN found f ON f.axis = c.axis AND f.bin = c.bin
LEFT JOIN prom p ON p.axis = f.axis AND p.bin = f.bin AND p.band_ix = f.band_ix""",
    }
    capture, size = f"axis || '-' || arrival_ix // {CAPTURE}", 16 + 12 * PACKET
    out["captured_packets"] = f"""SELECT {capture} AS capture_id, arrival_ix % {CAPTURE} AS arrival_ix, CAST({PACKET} AS INTEGER) AS n, CAST({ELAPSED} AS BIGINT) AS elapsed_us, arrival_ix AS sequence,
  round({PACKET - 1} / {ELAPSED} * 1e6, 9) AS fs, round(x / 256000, 12) AS x_sum, round(-x / 256000, 12) AS y_sum, round(2 * x / 256000, 12) AS z_sum
FROM pk JOIN (SELECT axis, g // {PACKET} AS arrival_ix, sum(round(value * 100)) AS x FROM ev GROUP BY 1, 2) v USING (axis, arrival_ix)"""
    out["captured_rest"] = f"""SELECT * FROM (
  SELECT {capture} AS capture_id, unnest(['fewer than two samples', 'no elapsed time', 'no frame', 'cut off']) AS reason,
    CAST(unnest([count_if(arrival_ix % 10 = 3) * 28, count_if(arrival_ix % 10 = 5) * {size}, count_if(arrival_ix % 10 = 7) * {len(JUNK)}, {size - 5}]) AS BIGINT) AS bytes
  FROM pk GROUP BY 1) t WHERE bytes > 0"""
    out["one_session_stats"] = "SELECT axis, bin, freq, count(*) AS sessions, round(avg(psd), 6) AS median, round(avg(psd), 6) AS mean, 0.0::DOUBLE AS std, 0.0::DOUBLE AS stability FROM aligned WHERE session_id = 1 GROUP BY axis, bin, freq"
    uneven = {
        "uneven_sessions": "SELECT axis, CAST(session_id AS INTEGER) AS session_id, round(fs, 9) AS fs, round(samples / fs, 9) AS duration, samples FROM rate",
        "uneven_stats": "SELECT axis, bin, round(freq, 6) AS freq, sessions, median, round(mean, 5) AS mean, round(std, 5) AS std, round(stability, 5) AS stability FROM stat2",
        "uneven_peaks": """SELECT f.axis, f.bin, f.band_ix, round(frequency, 6) AS frequency, amplitude, round(f.window_power_stability, 5) AS window_power_stability,
  round(local_snr_db, 5) AS local_snr_db, round(prominence, 5) AS prominence, round(mean_session_frequency, 5) AS mean_session_frequency FROM found f JOIN diag USING (axis, band_ix, bin)""",
    }
    interp = _sql("FROM psd").removesuffix("\nFROM psd") + jitter + """SELECT axis, CAST(session_id AS INTEGER) AS session_id, CAST(bin AS INTEGER) AS bin, round(freq, 6) AS freq,
  round(CASE WHEN freq = f0 THEN p0 ELSE p0 + (p1 - p0) / (f1 - f0) * (freq - f0) END, 6) AS psd
FROM br JOIN grid ON (freq >= f0 AND freq < f1) OR (f1 IS NULL AND freq = f0)"""
    return {name: interp if name == "interp_align" else _sql(text) for name, text in out.items()} | {name: _sql(text, True) for name, text in uneven.items()}
