"""Tables that a plot of the analysis would draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import background, first_band, in_bands, refused, unusable


KEY = ("capture_id", "axis", "bin")


def _with_peaks(stats: DataFrame, peaks: DataFrame) -> DataFrame:
    """stats and what peaks tells of their bins; a peak that is no bin, or lies at another frequency, is an error."""
    joined = stats.join(peaks.withColumnRenamed("frequency", "_at"), list(KEY), "full")
    wrong = F.when(F.col("freq").isNull(), "a peak must be exactly one bin of the statistics").when(
        F.col("_at") != F.col("freq"), "a peak must lie at its bin's frequency"
    )
    return joined.withColumn("freq", refused(wrong, F.col("freq"), "double")).drop("_at")


def spectrum_view(stats: DataFrame, peaks: DataFrame, bands: DataFrame) -> DataFrame:
    """Every bin with its statistics, background and contrast, and whether it is a peak.

    Peaks must be bins of the statistics; else reading the view is an error."""
    marks = peaks.select(*KEY, "frequency", F.lit(True).alias("is_peak"))
    return _with_peaks(background(stats, bands), marks).withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))


#: What a peak must tell, finite numbers all.
DIAGNOSTICS = (
    "window_power_stability", "mean_session_frequency", "frequency_std_hz", "minimum_session_frequency", "maximum_session_frequency", "local_noise_floor", "local_snr_db",
)


def assembled_view(stats: DataFrame, peaks: DataFrame, bands: DataFrame) -> DataFrame:
    """Every bin with its statistics, background, contrast, the thresholds of its first band and,
    where it is a peak, the peak's diagnostics, bases and prominence.

    Peaks must be bins of the statistics and have all diagnostics; else reading the view is an error."""
    limits = first_band(stats, bands).select(*KEY, F.col("band_ix").alias("first_band"), "min_stability", "min_snr_db")
    told = peaks.drop("amplitude").withColumnRenamed("band_ix", "peak_band")
    lacks = F.lit(False)
    for c in DIAGNOSTICS:
        lacks = lacks | unusable(F.col(c))
    band = refused(F.when(lacks, "a peak lacks a diagnostic"), F.col("peak_band"), "int")
    view = _with_peaks(background(stats, bands).join(limits, list(KEY)), told.withColumn("peak_band", band))
    return view.withColumn("is_peak", F.col("peak_band").isNotNull())


def bands_on_grid(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """The bands of each axis as its own bins show them: capture_id, axis, band_ix, name and, as
    min_frequency and max_frequency, the first and last bin inside.  A band without a bin is left out."""
    inside = in_bands(stats, bands).groupBy("capture_id", "axis", "band_ix", "name")
    return inside.agg(F.min("freq").alias("min_frequency"), F.max("freq").alias("max_frequency"))


def _of(bands: DataFrame) -> list[str]:
    return [c for c in ("capture_id", "axis") if c in bands.columns]


def band_limits(bands: DataFrame) -> DataFrame:
    """The envelope of all bands, of each axis if bands has axes."""
    return bands.groupBy(*_of(bands)).agg(F.min("min_frequency").alias("low"), F.max("max_frequency").alias("high"))


def band_edges(bands: DataFrame) -> DataFrame:
    """The distinct edges of all bands, in order, of each axis if bands has axes."""
    of = _of(bands)
    edges = bands.select(*of, F.col("min_frequency").alias("edge")).union(bands.select(*of, F.col("max_frequency").alias("edge")))
    return edges.distinct().orderBy(*of, "edge")


def band_labels(bands: DataFrame) -> DataFrame:
    """Names at the middle of their bands."""
    return bands.select(*_of(bands), "band_ix", "name", ((F.col("min_frequency") + F.col("max_frequency")) / 2).alias("position"))


def peak_labels(peaks: DataFrame) -> DataFrame:
    """Three lines of text for each peak."""
    text = F.format_string("%.1f Hz\nσf %.2f Hz\nSNR %.1f dB", "frequency", "frequency_std_hz", "local_snr_db")
    return peaks.select("capture_id", "axis", "bin", text.alias("label"))
