"""Settings of a capture analysis: TOML file, checks, and bands as a table."""

from __future__ import annotations

import math
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class ConfigError(Exception):
    """The file is missing, is no TOML, lacks a key, or holds a value that is not allowed."""


@dataclass(frozen=True)
class Band:
    name: str
    min_frequency: float
    max_frequency: float
    prominence_db: float
    min_distance_hz: float
    min_stability: float
    frequency_tolerance_hz: float
    noise_window_hz: float
    min_snr_db: float


@dataclass(frozen=True)
class Settings:
    port: str
    baud: int
    timeout_seconds: float
    packets_per_session: int
    min_recommended_sessions: int
    nperseg: int
    noverlap: int
    bands: tuple[Band, ...]


def _integer(value, what: str, least: int) -> None:
    if type(value) is not int or value < least:
        raise ValueError(f"{what} is {value!r}; set a whole number of {least} or more")


def _number(value, what: str) -> None:
    if type(value) not in (int, float) or not math.isfinite(value):
        raise ValueError(f"{what} is {value!r}; set a number other than NaN and infinity")


def _name(value, what: str) -> None:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} is {value!r}; give it a text that is not blank")


def check(s: Settings) -> Settings:
    """The settings, or ValueError about the first one that is not allowed."""
    _name(s.port, "port")
    _integer(s.baud, "baud", 1)
    _number(s.timeout_seconds, "timeout_seconds")
    if s.timeout_seconds < 0:
        raise ValueError(f"timeout_seconds is {s.timeout_seconds}; set 0 for no wait, or more")
    for field in ("packets_per_session", "min_recommended_sessions", "nperseg"):
        _integer(getattr(s, field), field, 1)
    _integer(s.noverlap, "noverlap", 0)
    if s.noverlap >= s.nperseg:
        raise ValueError(f"segments of {s.nperseg} samples cannot share {s.noverlap}; lower noverlap or raise nperseg")
    if not s.bands:
        raise ValueError("no band to look for peaks in; add one to analysis.bands")
    for b in s.bands:
        _name(b.name, "band name")
        for field, value in asdict(b).items():
            if field != "name":
                _number(value, f"band {b.name!r}: {field}")
                if value < 0:
                    raise ValueError(f"band {b.name!r}: {field} is {value}; set 0 or more")
        if b.max_frequency <= b.min_frequency:
            raise ValueError(f"band {b.name!r} ends at {b.max_frequency} Hz, where it begins or before; raise max_frequency")
        if b.noise_window_hz <= b.frequency_tolerance_hz:
            raise ValueError(f"band {b.name!r}: noise is sought beyond frequency_tolerance_hz; set noise_window_hz above {b.frequency_tolerance_hz}")
    return s


def load(path: str | Path) -> Settings:
    """Read and check a TOML file; every failure is a ConfigError."""
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        fields = list(Band.__dataclass_fields__)
        bands = tuple(Band(**{f: entry[f] for f in fields}) for entry in raw["analysis"]["bands"])
        sections = {"serial": ("port", "baud", "timeout_seconds"), "session": ("packets_per_session", "min_recommended_sessions"), "welch": ("nperseg", "noverlap")}
        values = {f: raw[section][f] for section, names in sections.items() for f in names}
        return check(Settings(**values, bands=bands))
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is not valid TOML: {e}") from e
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"bad setting in {path}: {e}") from e


def bands_table(spark: SparkSession, bands: tuple[Band, ...]) -> DataFrame:
    """One row a band; band_ix keeps the order, which decides where bands overlap."""
    kinds = ", ".join(f"{f} {'string' if f == 'name' else 'double'}" for f in Band.__dataclass_fields__)
    rows = [(i, b.name, *(float(v) for f, v in asdict(b).items() if f != "name")) for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, f"band_ix int, {kinds}")


def limits(bands: tuple[Band, ...]) -> tuple[float, float]:
    """The envelope of all bands."""
    return min(b.min_frequency for b in bands), max(b.max_frequency for b in bands)
