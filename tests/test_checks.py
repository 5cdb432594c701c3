import math

import pytest

from tremor.config import Band, bands_table
from tremor.operators import align, checks

GOOD = [("c", a, s, b, float(b), 1.0 + b) for a in "xyz" for s in (1, 2) for b in range(4)]
NAMES = "capture_id string, axis string, session_id int, bin int, freq double, psd double"


def table(spark, rows):
    return spark.createDataFrame(rows, NAMES)


def change(k, place, value):
    return [r if i != k else (*r[:place], value, *r[place + 1 :]) for i, r in enumerate(GOOD)]


@pytest.mark.parametrize("rows", [[], GOOD[:1] + GOOD[4:], change(1, 4, math.nan), change(1, 4, None), change(2, 4, 0.5), change(3, 5, math.inf), change(3, 5, -1.0), change(3, 5, None), GOOD[4:], [r for r in GOOD if r[3] == 0]])
def test_aligned_data_is_refused(spark, rows):
    with pytest.raises(ValueError):
        checks.check_aligned(table(spark, rows))


def test_good_data_passes(spark):
    rows = table(spark, GOOD)
    assert checks.check_aligned(rows) is rows and checks.check_spectra(rows) is rows and checks.check_grid(rows) is rows
    assert checks.check_aligned(table(spark, GOOD[4:]), equal_axes=False)
    bands = bands_table(spark, (Band("a", 0.0, 3.0, 0.1, 1.0, 0.5, 0.5, 2.0, 0.0),))
    stats = align.bin_stats(rows)
    checks.check_peak_input(stats, rows, bands)
    with pytest.raises(ValueError, match="same bins"):
        checks.check_peak_input(stats.where("bin < 3"), rows, bands)
    peak = "'c' as capture_id, 'x' as axis, 2 as bin, 2.0D as frequency, 1.0D as amplitude, 1.0D as window_power_stability, 2.0D as mean_session_frequency, 0.0D as frequency_std_hz, 1.0D as local_noise_floor, 3.0D as local_snr_db"
    checks.check_view_input(stats, spark.sql(f"select {peak}"))
    with pytest.raises(ValueError, match="exactly one bin"):
        checks.check_view_input(stats, spark.sql(f"select {peak.replace('2 as bin', '9 as bin')}"))
    with pytest.raises(ValueError, match="diagnostic"):
        checks.check_view_input(stats, spark.sql(f"select {peak.replace('3.0D as local', 'double(null) as local')}"))


def test_spectra_and_grids_are_refused(spark):
    with pytest.raises(ValueError, match="share their frequencies"):
        checks.check_spectra(table(spark, change(3, 4, 3.5)))
    with pytest.raises(ValueError, match="no sessions"):
        checks.check_spectra(table(spark, []))
    apart = [("c", "x", 1, b, float(b), 1.0) for b in range(4)] + [("c", "x", 2, b, b + 2.6, 1.0) for b in range(4)]
    with pytest.raises(ValueError, match="fewer than two grid"):
        checks.check_grid(table(spark, apart))


@pytest.mark.parametrize("band", [("a", -1.0, 3.0, 0.1, 1.0, 0.5, 0.5, 2.0, 0.0), ("a", 3.0, 3.0, 0.1, 1.0, 0.5, 0.5, 2.0, 0.0), ("a", 0.0, 3.0, -0.1, 1.0, 0.5, 0.5, 2.0, 0.0), ("a", 0.0, 3.0, 0.1, 1.0, 0.5, 0.5, 0.5, 0.0), ("a", 0.0, math.inf, 0.1, 1.0, 0.5, 0.5, 2.0, 0.0)])
def test_bands_are_refused(spark, band):
    with pytest.raises(ValueError):
        checks.check_bands(bands_table(spark, (Band(*band),)))


def test_finite_only(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,)], "v double")
    assert [r.v for r in checks.finite_only(df, "v").collect()] == [1.0]
    with pytest.raises(Exception, match="infinity"):
        checks.finite_only(spark.createDataFrame([(math.inf,)], "v double"), "v").collect()


def test_own_grid_is_identity_and_partitions_do_not_matter(spark):
    rows = table(spark, GOOD)
    got = sorted(map(tuple, align.align(rows).select("axis", "session_id", "bin", "freq", "psd").collect()))
    assert got == sorted(r[1:] for r in GOOD)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert got == sorted(map(tuple, align.align(rows).select("axis", "session_id", "bin", "freq", "psd").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
