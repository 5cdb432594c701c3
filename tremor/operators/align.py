"""Spectra of all sessions on one frequency grid, and statistics over sessions.

psd rows: capture_id, axis, session_id, freq, psd.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.storage import written

from .order import Ordered
from .sessions import KEY

TINY = 2.2250738585072014e-308


def unusable(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def refused(wrong: Column, value: Column, kind: str) -> Column:
    """value; where the text `wrong` is not null, reading it is an error with that text."""
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast(kind)).otherwise(value)


def common_range(psd: DataFrame) -> DataFrame:
    """capture_id, low, high: the range that every session and axis covers."""
    ends = psd.groupBy(*KEY).agg(F.min("freq").alias("first"), F.max("freq").alias("last"))
    return ends.groupBy("capture_id").agg(F.max("first").alias("low"), F.min("last").alias("high"))


def grid(psd: DataFrame, axis: str | None = None) -> DataFrame:
    """capture_id, bin, freq: the frequencies of the first session of one axis (the first axis
    by name if none is given) inside the common range."""
    first = psd.where(F.col("axis") == axis) if axis else psd
    least = first.groupBy("capture_id").agg(F.min(F.struct("axis", "session_id")).alias("one"))
    rows = psd.join(least, "capture_id").where("axis = one.axis and session_id = one.session_id").join(common_range(psd), "capture_id")
    rank = F.row_number().over(W.partitionBy("capture_id").orderBy("freq")) - 1
    return rows.where("freq between low and high").select("capture_id", rank.alias("bin"), "freq")


def _spectra(psd: DataFrame) -> DataFrame:
    """A row a spectrum: f and p in order of frequency."""
    points = F.array_sort(F.collect_list(F.struct(F.col("freq").cast("double").alias("f"), F.col("psd").cast("double").alias("p"))))
    return psd.groupBy(*KEY).agg(points.alias("points")).select(*KEY, F.col("points.f").alias("f"), F.col("points.p").alias("p"))


def _grids(spectra: DataFrame, axis: str | None, equal_axes: bool) -> DataFrame:
    """capture_id, grid: the frequencies that a capture's spectra are put on.

    Reading the grid of a capture that must be refused is an error; what decides is gathered in the
    pass that finds the common range."""
    bad = lambda c: F.exists(c, unusable)
    rising = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("f") - 1), lambda i: F.get("f", i) <= F.get("f", i - 1)), lambda x: x))
    flat = F.when(F.size("f") > 1, rising > 0).otherwise(False)
    told = spectra.select(
        *KEY, "f", F.xxhash64("f").alias("shape"), F.size("f").alias("n"), F.element_at("f", 1).alias("first"), F.element_at("f", -1).alias("last"),
        bad("f").alias("bad_f"), bad("p").alias("bad_p"), F.exists("p", lambda x: x < 0).alias("negative"), flat.alias("flat"),
    )
    here = (F.col("axis") == axis) if axis else F.lit(True)
    flags = ("bad_f", "bad_p", "negative", "flat")
    ends = told.groupBy("capture_id").agg(
        F.max("first").alias("low"), F.min("last").alias("high"), F.min("n").alias("n"), *(F.max(c).alias(c) for c in flags),
        F.min_by(F.when(here, F.col("f")), F.when(here, F.struct("axis", "session_id"))).alias("own"),
    )
    shared = told.groupBy("capture_id", "session_id").agg((F.min("shape") != F.max("shape")).alias("differ"), F.count(F.lit(1)).alias("axes"))
    axes = shared.groupBy("capture_id").agg(F.max("differ").alias("differ"), (F.min("axes") != F.max("axes")).alias("uneven"))
    grid = F.filter("own", lambda f: f.between(F.col("low"), F.col("high")))
    wrong = (
        F.when(F.col("bad_f"), "a frequency is missing or not finite")
        .when(F.col("n") < 2, "a spectrum has fewer than two frequencies")
        .when(F.col("flat"), "frequencies must rise")
        .when(F.col("bad_p"), "a power is missing or not finite")
        .when(F.col("negative"), "a power is negative")
        .when(F.col("differ"), "the axes of a session must share their frequencies")
        .when(F.lit(equal_axes) & F.col("uneven"), "all axes need the same number of sessions")
        .when(F.col("own").isNull(), "no session of the axis that gives the grid")
        .when(F.col("high") <= F.col("low"), "the sessions share no range of frequencies")
        .when(F.size(grid) < 2, "the common range of the sessions holds fewer than two grid frequencies")
    )
    return ends.join(axes, "capture_id").select("capture_id", refused(wrong, grid, "array<double>").alias("grid"))


def _interpolated(batches):
    """Each spectrum on its grid: between the points before and behind, and exact at a point."""
    for b in batches:
        f, p, grid = (b.column(c) for c in ("f", "p", "grid"))
        ends = [np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64) for c in (f, p, grid)]
        fs, ps, gs = (c.flatten().to_numpy(zero_copy_only=False) for c in (f, p, grid))
        out = []
        for r in range(b.num_rows):
            x, y, want = fs[ends[0][r] : ends[0][r + 1]], ps[ends[1][r] : ends[1][r + 1]], gs[ends[2][r] : ends[2][r + 1]]
            low = np.searchsorted(x, want, side="right") - 1
            next_ = np.minimum(low + 1, len(x) - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                between = y[low] + (y[next_] - y[low]) / (x[next_] - x[low]) * (want - x[low])
            out.append(np.where(want == x[low], y[low], between))
        many = np.diff(ends[2])
        rows = pa.array(np.repeat(np.arange(b.num_rows), many))
        bins = np.arange(ends[2][-1]) - np.repeat(ends[2][:-1], many)
        values = np.concatenate([np.zeros(0), *out])
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(rows) for c in KEY), pa.array(bins.astype(np.int32)), pa.array(gs), pa.array(values)], [*KEY, "bin", "freq", "psd"]
        )


def align(psd: DataFrame, axis: str | None = None, equal_axes: bool = False) -> DataFrame:
    """psd linearly interpolated onto the grid; exact at a session's own frequencies.

    A spectrum and its grid are two sorted arrays of one row, merged in linear time.  Spectra
    without two rising finite frequencies or with powers that are missing, infinite or negative, axes
    of a session on unlike frequencies, sessions without a common range of two grid frequencies and,
    with equal_axes, sessions that lack an axis make reading the result an error.
    """
    spectra = written(_spectra(psd), "spectra")
    kind = dict(psd.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in KEY) + ", bin int, freq double, psd double"
    return spectra.join(_grids(spectra, axis, equal_axes), "capture_id").select(*KEY, "f", "p", "grid").mapInArrow(_interpolated, schema)


def check_psd(psd: DataFrame) -> DataFrame:
    """psd as it is, or ValueError: two frequencies a session at least, strictly increasing, powers
    finite and not negative, and a common range.  One aggregate over the table."""
    w = W.partitionBy(*KEY).orderBy("freq")
    bad = F.col("psd").isNull() | F.isnan("psd") | (F.abs("psd") == float("inf")) | (F.col("psd") < 0)
    marked = psd.select(*KEY, "freq", bad.alias("bad"), (F.lag("freq").over(w) >= F.col("freq")).alias("same"))
    each = marked.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if("same").alias("same"))
    row = each.agg(F.count("*").alias("spectra"), F.min("n").alias("n"), F.sum("bad").alias("bad"), F.sum("same").alias("same")).first()
    if not row.spectra:
        raise ValueError("no sessions to analyse")
    if row.n < 2:
        raise ValueError("a spectrum has fewer than two frequencies")
    if row.bad:
        raise ValueError("a power is missing, not finite or negative")
    if row.same:
        raise ValueError("frequencies must rise")
    if common_range(psd).where("high <= low").count():
        raise ValueError("the sessions share no range of frequencies")
    return psd


BIN = ("capture_id", "axis", "bin")


def bin_stats(aligned: DataFrame) -> DataFrame:
    """capture_id, axis, bin, freq, sessions, median, mean, std (population), stability (0 where std is 0).

    The median is exact; it is found in ranges of ordered powers (`Ordered.middle`), so a bin
    may have any number of sessions.  aligned is written on the way and read from there."""
    ordered = Ordered(aligned.select(*BIN, "freq", "psd"), list(BIN), ["psd"])
    moments = ordered.rows.groupBy(*BIN).agg(
        F.first("freq").alias("freq"), F.count("*").alias("sessions"), F.avg("psd").alias("mean"), F.stddev_pop("psd").alias("std")
    )
    out = moments.join(ordered.middle("psd"), list(BIN)).select(*BIN, "freq", "sessions", "median", "mean", "std")
    return out.withColumn("stability", F.when(F.col("std") != 0, F.col("mean") / F.col("std")).otherwise(0.0))


def decibels(value):
    """10 * log10 of a power, zero taken as the smallest normal number; null stays null."""
    return F.when(value.isNotNull(), 10 * F.log10(F.greatest(value, F.lit(TINY))))


def in_bands(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """Bins with every band they lie in, both edges included (bands: a handful of rows)."""
    return stats.join(F.broadcast(bands), F.col("freq").between(F.col("min_frequency"), F.col("max_frequency")))


def first_band(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """All bins with the first band, by band_ix, that they lie in, if any."""
    order = F.row_number().over(W.partitionBy("capture_id", "axis", "bin").orderBy("band_ix"))
    near = stats.join(F.broadcast(bands), F.col("freq").between(F.col("min_frequency"), F.col("max_frequency")), "left")
    return near.withColumn("_order", order).where("_order = 1").drop("_order")


def sliding_medians(value: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Medians of a window that slides over value, and its sizes.

    The window at step i is the union of value[a[i]:e[i]] over the parts (a, e), which are
    apart and whose ends do not fall.  A sorted list takes each value in and out once a part."""
    held: list[float] = []
    sizes, out = np.zeros(len(parts[0][0]), np.int64), np.full(len(parts[0][0]), np.nan)
    last = [(0, 0)] * len(parts)
    for i in range(len(out)):
        for k, (a, e) in enumerate(parts):
            lo, hi, (lo0, hi0) = int(a[i]), max(int(a[i]), int(e[i])), last[k]
            for v in value[lo0 : min(lo, hi0)]:
                del held[bisect.bisect_left(held, v)]
            for v in value[max(lo, hi0) : hi]:
                bisect.insort(held, float(v))
            last[k] = (lo, hi)
        n = sizes[i] = len(held)
        if n:
            out[i] = (held[(n - 1) // 2] + held[n // 2]) / 2
    return out, sizes


def _floors(by: list[str]):
    def run(centres: pd.DataFrame, noise: pd.DataFrame) -> pd.DataFrame:
        noise = noise.sort_values("noise_freq")
        f, v = noise["noise_freq"].to_numpy(float), noise["noise_psd"].to_numpy(float)
        found = []
        limits = ["min_frequency", "max_frequency", "noise_window_hz", "frequency_tolerance_hz"]
        for (low, high, window, tolerance), c in centres.groupby(limits, sort=False):
            c = c.sort_values("freq")
            x = c["freq"].to_numpy(float)
            first, end = np.searchsorted(f, np.maximum(x - window, low)), np.searchsorted(f, np.minimum(x + window, high), side="right")
            inner, outer = np.searchsorted(f, x - tolerance), np.searchsorted(f, x + tolerance, side="right")
            floor, n = sliding_medians(v, [(first, np.minimum(inner, end)), (np.maximum(outer, first), end)])
            found.append(c[by].assign(floor=floor, noise_points=n)[n >= 3])
        return pd.concat(found) if found else centres[by].assign(floor=0.0, noise_points=0)

    return run


def noise_floor(centres: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Medians around centres, which carry their band's columns: bins within noise_window_hz and
    the band, without those within frequency_tolerance_hz.  by: the columns that name a centre.

    An axis is a task: its bins in order, and a window of order statistics that slides over them.
    A centre outside its band, a window no wider than the tolerance and a power that is missing,
    not finite or negative are errors."""
    power = refused(F.when(unusable(F.col("median")) | (F.col("median") < 0), "a power is missing, not finite or negative"), F.col("median"), "double")
    # names of its own, as centres may come from the same rows
    noise = stats.select(F.col("capture_id").alias("noise_capture"), F.col("axis").alias("noise_axis"), F.col("freq").alias("noise_freq"), power.alias("noise_psd"))
    wrong = (
        F.when(~F.col("freq").between(F.col("min_frequency"), F.col("max_frequency")), "a centre lies outside its band")
        .when(F.col("noise_window_hz") <= F.col("frequency_tolerance_hz"), "a noise window must be wider than the frequency tolerance")
        .when(F.col("frequency_tolerance_hz") < 0, "a frequency tolerance is negative")
    )
    kinds = dict(centres.dtypes)
    asked = centres.select(
        *dict.fromkeys([*by, "capture_id", "axis"]), refused(wrong, F.col("freq"), "double").alias("freq"),
        "min_frequency", "max_frequency", "noise_window_hz", "frequency_tolerance_hz",
    )
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", floor double, noise_points long"
    return asked.groupBy("capture_id", "axis").cogroup(noise.groupBy("noise_capture", "noise_axis")).applyInPandas(_floors(by), schema)


def background(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """stats with local_psd_background (null outside the bands or with under 3 noise bins) and
    local_psd_contrast_db.  A median or background that is negative or not finite is an error."""
    key = ["capture_id", "axis", "bin"]
    floor = noise_floor(first_band(stats, bands).where("band_ix is not null"), stats, key)
    joined = stats.join(floor.select(*key, F.col("floor").alias("local_psd_background")), key, "left")
    return joined.withColumn("local_psd_contrast_db", contrast(F.col("median"), F.col("local_psd_background")))


def contrast(power: Column, ground: Column) -> Column:
    """Decibels of a power above its background; null where there is none (null or NaN)."""
    ground = F.when(~F.isnan(ground), ground)
    wrong = F.when(unusable(power) | (power < 0), "a power is missing, not finite or negative").when(
        ground.isNotNull() & (unusable(ground) | (ground < 0)), "a background is not finite or negative"
    )
    return refused(wrong, decibels(power) - decibels(ground), "double")
