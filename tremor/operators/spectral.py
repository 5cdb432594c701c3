"""Windowed spectra of signal rows (operators.sessions.signals), by numpy in Arrow batches.

Each row is transformed by itself, so no shuffle is needed; only bins inside the wanted
range leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import KEY

#: Samples that are transformed at once: 8 MB, and a few times that in segments.
_SAMPLES = 1 << 20


def hann(i: Column, m: int, periodic: bool) -> Column:
    """The Hann window at place i of m; the symmetric one ends at zero on both sides."""
    if m == 1:
        return F.lit(1.0)
    return 0.5 - 0.5 * F.cos(2 * np.pi * i / (m if periodic else m - 1))


def _hann(m: int, periodic: bool) -> np.ndarray:
    return np.ones(1) if m == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / (m if periodic else m - 1))


def _segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., :: size - overlap, :]


def _amplitudes(x: np.ndarray) -> np.ndarray:
    """Amplitudes along the last axis under a symmetric window, all bins doubled."""
    w = _hann(x.shape[-1], False)
    return np.abs(np.fft.rfft(x * w, axis=-1)) * 2 / w.sum()


def _frequencies(size: int, fs) -> np.ndarray:
    """The frequencies of a transform of `size` samples, a row for each rate."""
    return np.arange(size // 2 + 1) * (1.0 / (size * (1 / np.asarray(fs, float)[..., None])))


def _whole(x: np.ndarray, fs: np.ndarray) -> tuple[int, np.ndarray]:
    return x.shape[-1], _amplitudes(x)


def _mean(nperseg: int, noverlap: int):
    def run(x: np.ndarray, fs: np.ndarray) -> tuple[int, np.ndarray]:
        size = min(nperseg, x.shape[-1])
        return size, _amplitudes(_segments(x, size, min(noverlap, size // 2))).mean(axis=-2)

    return run


def _density(nperseg: int, noverlap: int):
    def run(x: np.ndarray, fs: np.ndarray) -> tuple[int, np.ndarray]:
        size = min(nperseg, x.shape[-1])
        overlap = min(noverlap, x.shape[-1] // 2)
        if overlap >= size:
            raise ValueError("an overlap as long as its segment leaves no step; lower noverlap")
        w = _hann(size, True)
        part = _segments(x, size, overlap)
        power = np.abs(np.fft.rfft((part - part.mean(axis=-1, keepdims=True)) * w, axis=-1)) ** 2 / (np.asarray(fs, float)[..., None, None] * (w * w).sum())
        power[..., 1 : -1 if size % 2 == 0 else None] *= 2
        return size, power.mean(axis=-2)

    return run


def _alone(one: Callable, x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    size, value = one(np.asarray(x, float), np.asarray(fs))
    return _frequencies(size, fs), value


def whole_fft(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes of the whole signal under a symmetric window, all bins doubled."""
    return _alone(_whole, x, fs)


def mean_fft(x: np.ndarray, fs: float, nperseg: int, noverlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean amplitudes of full segments, not detrended; the overlap is at most half a segment."""
    return _alone(_mean(nperseg, noverlap), x, fs)


def welch_psd(x: np.ndarray, fs: float, nperseg: int, noverlap: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: periodic window, each segment's mean removed, powers averaged.

    The overlap is limited by half the signal, not half the segment; if it then leaves no
    step, it is an error."""
    return _alone(_density(nperseg, noverlap), x, fs)


def _spectra(signals: DataFrame, value: str, one: Callable, low: float | None = None, high: float | None = None) -> DataFrame:
    """Signals of one length in a batch are rows of one matrix, transformed at once."""
    names = [*KEY, "bin", "freq", value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signal, fs = b.column("signal"), b.column("fs").to_numpy()
            size = signal.value_lengths().to_numpy(zero_copy_only=False)
            flat, start = signal.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            for m in np.unique(size):
                rows = np.flatnonzero(size == m)
                for part in np.array_split(rows, -(-len(rows) * int(m) // _SAMPLES)):
                    width, found = one(flat[start[part][:, None] + np.arange(m)], fs[part])
                    f = _frequencies(width, fs[part])
                    row, at = np.nonzero((f >= (-np.inf if low is None else low)) & (f <= (np.inf if high is None else high)))
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).take(pa.array(part[row])) for c in KEY), pa.array(at.astype(np.int32)), pa.array(f[row, at]), pa.array(found[row, at])], names
                    )

    schema = f"capture_id string, axis string, session_id int, bin int, freq double, {value} double"
    return signals.where("samples > 0").select(*KEY, "fs", "signal").mapInArrow(run, schema)


def fft(signals: DataFrame) -> DataFrame:
    return _spectra(signals, "amplitude", _whole)


def average_fft(signals: DataFrame, nperseg: int, noverlap: int) -> DataFrame:
    return _spectra(signals, "amplitude", _mean(nperseg, noverlap))


def welch(signals: DataFrame, nperseg: int, noverlap: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """psd rows; low and high (inclusive) are the envelope of the bands, gaps between bands stay."""
    return _spectra(signals, "psd", _density(nperseg, noverlap), low, high)


def resolutions(signals: DataFrame, nperseg: int) -> DataFrame:
    """Bin widths of the whole and the segmented spectrum."""
    return signals.select(*KEY, (F.col("fs") / F.col("samples")).alias("fft_resolution"), (F.col("fs") / F.least(F.lit(nperseg), F.col("samples"))).alias("psd_resolution"))
