"""Peaks of each band of the median spectrum, qualified over sessions.

Order: band slice, local maxima, distance, prominence, noise bins, signal to noise, window
power and session peaks, stability, one peak for a bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.storage import written

from .align import decibels, in_bands, noise_floor, refused, unusable
from .checks import check_bands

SLICE = ("capture_id", "axis", "band_ix")


def band_slices(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """Bins by band with db, the median in decibels; bands of one bin are left out.

    A median or frequency that is missing, not finite or negative is an error."""
    size = F.count("*").over(W.partitionBy(*SLICE))
    wrong = F.when(unusable(F.col("median")) | (F.col("median") < 0), "a median is missing, not finite or negative").when(
        unusable(F.col("freq")), "a frequency is missing or not finite"
    )
    median = refused(wrong, F.col("median"), "double")
    return in_bands(stats, bands).withColumn("db", decibels(median)).withColumn("_n", size).where("_n >= 2").drop("_n")


def local_maxima(slices: DataFrame) -> DataFrame:
    """capture_id, axis, band_ix, bin, db: strict rises followed by strict falls; of a flat top the
    middle bin, rounded down; the ends of a slice are no peaks."""
    w = W.partitionBy(*SLICE).orderBy("bin")
    change = F.coalesce((F.lag("db").over(w) != F.col("db")).cast("int"), F.lit(1))
    runs = slices.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    flat = runs.groupBy(*SLICE, "_run").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.first("db").alias("db"))
    v = W.partitionBy(*SLICE).orderBy("_run")
    sides = flat.withColumn("before", F.lag("db").over(v)).withColumn("after", F.lead("db").over(v))
    return sides.where("before < db and after < db").select(*SLICE, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("bin"), "db")


def resolution(stats: DataFrame) -> DataFrame:
    """capture_id, resolution: the width of the grid's first bin."""
    at = lambda k: F.max(F.when(F.col("bin") == k, F.col("freq")))
    return stats.groupBy("capture_id").agg((at(1) - at(0)).alias("resolution"))


def keep_apart(at: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Which of the maxima at rising places stay: from the highest down (ties: the higher place
    first), each drops those nearer than the distance.

    Only neighbours of one that stays are looked at, so a run of maxima that a gap of the
    distance or more sets apart is settled by itself, in time linear in its length but for the sort."""
    stays = np.ones(len(at), bool)
    for k in np.lexsort((-at, -height)):
        if stays[k]:
            stays[np.searchsorted(at, at[k] - distance, side="right") : k] = False
            stays[k + 1 : np.searchsorted(at, at[k] + distance)] = False
    return stays


def spaced(maxima: DataFrame, stats: DataFrame, bands: DataFrame) -> DataFrame:
    """Maxima from the highest down (ties: the higher bin first), each dropping those nearer than the band's distance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf[keep_apart(pdf["bin"].to_numpy(), pdf["db"].to_numpy(), pdf["distance"].iloc[0])][[*SLICE, "bin", "db"]]

    distance = F.greatest(F.floor(F.col("min_distance_hz") / F.col("resolution")), F.lit(1)).cast("double")
    wide = maxima.join(F.broadcast(bands.select("band_ix", "min_distance_hz")), "band_ix").join(resolution(stats), "capture_id")
    schema = ", ".join(f"{c} {kind}" for c, kind in maxima.select(*SLICE, "bin", "db").dtypes)
    return wide.select(*SLICE, "bin", "db", distance.alias("distance")).groupBy(*SLICE).applyInPandas(run, schema)


def walls(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its lowest level, and where that is nearest, going left until a level is higher.

    A stack of falling levels holds the places that can still be a wall; a place takes over what
    the places it pushes off have found, so each is looked at twice at most."""
    low, base = level.astype(float).copy(), np.arange(len(level))
    stack: list[int] = []
    for i, x in enumerate(level):
        while stack and level[stack[-1]] <= x:
            k = stack.pop()
            if low[k] < low[i]:
                low[i], base[i] = low[k], base[k]
        stack.append(i)
    return low, base


def prominences(peaks: DataFrame, slices: DataFrame) -> DataFrame:
    """peaks with prominence, left_base, right_base, seen inside the slice only."""

    def run(peaks: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        slices = slices.sort_values("bin")
        bins, level = slices["bin"].to_numpy(), slices["db"].to_numpy()
        at = np.searchsorted(bins, peaks["bin"].to_numpy())
        left, left_at = walls(level)
        right, right_at = (x[::-1] for x in walls(level[::-1]))
        lowest = np.maximum(left, right)[at]
        bases = {"left_base": bins[left_at[at]], "right_base": bins[len(bins) - 1 - right_at[at]]}
        return peaks[[*SLICE, "bin", "db"]].assign(prominence=level[at] - lowest, **bases)

    kinds = dict(slices.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in SLICE) + f", bin {kinds['bin']}, db double, prominence double, left_base {kinds['bin']}, right_base {kinds['bin']}"
    own = [f"slice_{c}" for c in SLICE]  # names of its own, as peaks may come from the same rows
    points = slices.select(*(F.col(c).alias(n) for c, n in zip(SLICE, own, strict=True)), F.col("bin").alias("bin"), F.col("db").alias("db"))
    return peaks.select(*SLICE, "bin", "db").groupBy(*SLICE).cogroup(points.groupBy(*own)).applyInPandas(run, schema)


def session_windows(centres: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row a centre and session: window_power and the session's own peak_frequency within
    frequency_tolerance_hz of the centre.

    Two bins or more: trapezoids; one: its power times its width on the grid; of equal
    powers the lowest frequency is the peak."""
    w = W.partitionBy("capture_id", "axis", "session_id").orderBy("bin")
    f0, f1 = F.lag("freq").over(w), F.lead("freq").over(w)
    width = F.when(f0.isNull(), f1 - F.col("freq")).when(f1.isNull(), F.col("freq") - f0).otherwise((f1 - f0) / 2)
    wrong = F.when(unusable(F.col("psd")) | (F.col("psd") < 0), "a power is missing, not finite or negative")
    power = refused(wrong, F.col("psd"), "double").alias("psd")
    points = aligned.select("capture_id", "axis", "session_id", F.col("bin").alias("at"), F.col("freq").alias("f"), power, width.alias("width"))
    inside = centres.join(points, ["capture_id", "axis"]).where("f between freq - frequency_tolerance_hz and freq + frequency_tolerance_hz")
    key = [*SLICE, "bin", "session_id"]
    v = W.partitionBy(*key).orderBy("at")
    area = (F.col("psd") + F.lead("psd").over(v)) / 2 * (F.lead("f").over(v) - F.col("f"))
    steps = inside.select(*key, "f", "psd", "width", area.alias("area"))
    return steps.groupBy(*key).agg(
        F.when(F.count("*") > 1, F.sum("area")).otherwise(F.max(F.col("psd") * F.col("width"))).alias("window_power"),
        F.max_by("f", F.struct(F.col("psd"), -F.col("f"))).alias("peak_frequency"),
    )


def diagnostics(windows: DataFrame) -> DataFrame:
    """Over sessions: stability of the window power; mean, deviation and range of the session peaks."""
    power, std = F.avg("window_power"), F.stddev_pop("window_power")
    f = "peak_frequency"
    return windows.groupBy(*SLICE, "bin").agg(
        F.when(std != 0, power / std).otherwise(0.0).alias("window_power_stability"),
        F.avg(f).alias("mean_session_frequency"),
        F.stddev_pop(f).alias("frequency_std_hz"),
        F.min(f).alias("minimum_session_frequency"),
        F.max(f).alias("maximum_session_frequency"),
        F.count(F.lit(1)).alias("window_sessions"),
    )


def find_peaks(stats: DataFrame, aligned: DataFrame, bands: DataFrame) -> DataFrame:
    """The peaks of all bands, one for a bin: the more prominent, then the first band's.

    Bands that may not be (`check_bands`) are refused at once; statistics or spectra that are
    missing, not finite or negative, and bins that only one of the two has, make reading an error."""
    key = [*SLICE, "bin"]
    check_bands(bands)
    slices = band_slices(stats, bands)
    counted = ["sessions"] if "sessions" in stats.columns else []
    shaped = prominences(spaced(local_maxima(slices), stats, bands), slices)
    # candidates are few next to bins, and read twice each: by what qualifies them and by what they become
    wide = written(
        shaped.join(F.broadcast(bands), "band_ix")
        .where("prominence >= prominence_db")
        .join(stats.select("capture_id", "axis", "bin", "freq", F.col("median").alias("amplitude"), *counted), ["capture_id", "axis", "bin"]),
        "candidates",
    )
    loud = written(
        wide.join(noise_floor(wide, stats, key), key)
        .withColumn("local_snr_db", decibels(F.col("amplitude")) - decibels(F.col("floor")))
        .where("local_snr_db >= min_snr_db"),
        "loud",
    )
    told = loud.join(diagnostics(session_windows(loud, aligned)), key, "left")
    wrong = F.when(F.col("window_power_stability").isNull(), "statistics and spectra must have the same bins")
    if counted:
        wrong = wrong.when(F.col("sessions") != F.col("window_sessions"), "statistics and spectra must have the same sessions")
    told = told.withColumn("window_power_stability", refused(wrong, F.col("window_power_stability"), "double"))
    stable = told.where("window_power_stability >= min_stability")
    best = F.row_number().over(W.partitionBy("capture_id", "axis", "bin").orderBy(F.desc("prominence"), "band_ix"))
    return stable.withColumn("_best", best).where("_best = 1").select(
        "capture_id", "axis", "bin", "band_ix", F.col("freq").alias("frequency"), "amplitude", "window_power_stability",
        "mean_session_frequency", "frequency_std_hz", "minimum_session_frequency", "maximum_session_frequency",
        F.col("floor").alias("local_noise_floor"), "local_snr_db", "prominence", "left_base", "right_base",
    )


def ordered(peaks: DataFrame) -> DataFrame:
    """peaks in order of capture, axis and bin, numbered from 1 within their axis."""
    place = F.row_number().over(W.partitionBy("capture_id", "axis").orderBy("bin"))
    return peaks.withColumn("place", place).orderBy("capture_id", "axis", "bin")
