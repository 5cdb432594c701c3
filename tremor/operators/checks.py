"""Checks of whole tables before work begins, each one aggregate.

The operators themselves refuse the same input as they read it (align.refused), without a job
of its own; these say so at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import align
from .sessions import KEY


def unusable(name: str) -> Column:
    """Null, NaN or infinite."""
    return align.unusable(F.col(name))


def _refuse(found, texts: dict[str, str]) -> None:
    for column, text in texts.items():
        if found[column]:
            raise ValueError(text)


def finite_only(df: DataFrame, name: str) -> DataFrame:
    """Rows whose value is there: nulls and NaN drop out, an infinity is an error when the rows are read."""
    value = F.when(F.abs(F.col(name)) == float("inf"), F.raise_error(F.lit(f"{name} holds an infinity")).cast("double")).otherwise(F.col(name))
    return df.where(F.col(name).isNotNull() & ~F.isnan(name)).withColumn(name, value)


def check_spectra(psd: DataFrame) -> DataFrame:
    """psd, or ValueError: every axis of a session on one frequency grid, and sessions at all."""
    each = psd.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.xxhash64("freq").cast("decimal(38,0)")).alias("grid"))
    sessions = each.groupBy("capture_id", "session_id").agg(F.count_distinct("n", "grid").alias("grids"))
    found = sessions.agg((F.count("*") == 0).alias("none"), F.max(F.col("grids") > 1).alias("differ")).first()
    _refuse(found, {"none": "no sessions to analyse", "differ": "the axes of a session must share their frequencies"})
    return psd


def check_grid(psd: DataFrame, axis: str | None = None) -> DataFrame:
    """psd, or ValueError: two grid frequencies at least inside the common range of every capture."""
    per = align.grid(psd, axis).groupBy("capture_id").agg(F.count("*").alias("bins"))
    wrong = psd.select("capture_id").distinct().join(per, "capture_id", "left").where("coalesce(bins, 0) < 2")
    if wrong.limit(1).count():
        raise ValueError("the common range of the sessions holds fewer than two grid frequencies")
    return psd


def check_aligned(aligned: DataFrame, equal_axes: bool = True) -> DataFrame:
    """aligned, or ValueError: finite increasing frequencies, two at least, the same bins in every
    spectrum, finite powers of zero or more, and, with equal_axes, as many sessions on each axis."""
    w = W.partitionBy(*KEY).orderBy("bin")
    marked = aligned.select(
        *KEY, "bin", "freq", unusable("freq").alias("bad_freq"), (F.lag("freq").over(w) >= F.col("freq")).alias("falls"),
        unusable("psd").alias("bad_psd"), (F.col("psd") < 0).alias("negative"),
    )
    each = marked.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("bin", "freq").cast("decimal(38,0)")).alias("bins"),
        *(F.count_if(c).alias(c) for c in ("bad_freq", "falls", "bad_psd", "negative")),
    )
    axes = each.groupBy("capture_id", "axis").agg(
        F.count("*").alias("sessions"), F.min("n").alias("n"), F.count_distinct("n", "bins").alias("shapes"), F.min("bins").alias("bins"),
        *(F.sum(c).alias(c) for c in ("bad_freq", "falls", "bad_psd", "negative")),
    )
    captures = axes.groupBy("capture_id").agg(F.count_distinct("sessions").alias("counts"), F.count_distinct("bins").alias("grids"), F.min("n").alias("n"), F.max("shapes").alias("shapes"), *(F.sum(c).alias(c) for c in ("bad_freq", "falls", "bad_psd", "negative")))
    found = captures.agg(
        (F.count("*") == 0).alias("none"), F.max(F.col("n") < 2).alias("short"), F.max((F.col("shapes") > 1) | (F.col("grids") > 1)).alias("shapes"),
        F.max(F.col("counts") > 1).alias("counts"), *((F.sum(c) > 0).alias(c) for c in ("bad_freq", "falls", "bad_psd", "negative")),
    ).first()
    texts = {
        "none": "no aligned spectra", "bad_freq": "a frequency is missing or not finite", "short": "a spectrum has fewer than two bins",
        "falls": "frequencies must rise from bin to bin", "bad_psd": "a power is missing or not finite", "negative": "a power is negative",
        "shapes": "all spectra of a capture must have the same bins",
    }
    _refuse(found, texts | ({"counts": "all axes need the same number of sessions"} if equal_axes else {}))
    return aligned


_BAND_RULES = {
    "min_frequency < 0": "a band begins below zero",
    "max_frequency <= min_frequency": "a band ends where it begins or before",
    "prominence_db < 0 or min_distance_hz < 0 or min_stability < 0 or min_snr_db < 0": "a threshold of a band is negative",
    "frequency_tolerance_hz < 0": "a frequency tolerance is negative",
    "noise_window_hz <= frequency_tolerance_hz": "a noise window must be wider than the frequency tolerance",
}


def check_bands(bands: DataFrame) -> DataFrame:
    """bands, or ValueError: one at least, finite numbers, and the order of edges and windows."""
    numbers = [c for c, kind in bands.dtypes if kind == "double"]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | unusable(c)
    found = bands.agg((F.count("*") == 0).alias("none"), F.max(bad).alias("bad"), *(F.max(F.expr(rule)).alias(f"rule{k}") for k, rule in enumerate(_BAND_RULES))).first()
    _refuse(found, {"none": "set one analysis band or more", "bad": "a number of a band is missing or not finite"} | {f"rule{k}": t for k, t in enumerate(_BAND_RULES.values())})
    return bands


def check_peak_input(stats: DataFrame, aligned: DataFrame, bands: DataFrame) -> None:
    """ValueError unless stats has one finite row of zero or more for every aligned bin, and bands hold."""
    check_bands(bands)
    key = ["capture_id", "axis", "bin"]
    bins = aligned.groupBy(*key).agg(F.min("freq").alias("grid_freq"))
    own = stats.groupBy(*key).agg(F.count("*").alias("n"), F.min("freq").alias("freq"), *(F.count_if(unusable(c) | (F.col(c) < 0)).alias(c) for c in ("median", "stability")))
    found = own.join(bins, key, "full").agg(
        F.max(F.col("n").isNull() | F.col("grid_freq").isNull() | (F.col("n") > 1) | (F.col("freq") != F.col("grid_freq"))).alias("bins"),
        F.max((F.col("median") > 0) | (F.col("stability") > 0)).alias("values"),
    ).first()
    _refuse(found, {"bins": "statistics and spectra must have the same bins, once each", "values": "a median or stability is missing, not finite or negative"})


def check_view_input(stats: DataFrame, peaks: DataFrame) -> None:
    """ValueError unless every peak is one bin of stats, at its frequency, with all its diagnostics."""
    key = ["capture_id", "axis", "bin"]
    bins = stats.groupBy(*key).agg(F.count("*").alias("n"), F.min("freq").alias("freq"))
    told = F.lit(False)
    for c in ("amplitude", "window_power_stability", "mean_session_frequency", "frequency_std_hz", "local_noise_floor", "local_snr_db"):
        told = told | unusable(c)
    found = peaks.join(bins, key, "left").agg(
        F.max(F.col("n").isNull() | (F.col("n") != 1) | (F.col("freq") != F.col("frequency"))).alias("bins"), F.max(told).alias("told")
    ).first()
    _refuse(found, {"bins": "a peak must be exactly one bin of the statistics", "told": "a peak lacks a diagnostic"})
