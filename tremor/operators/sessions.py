"""Count windows: packets to sessions to signals.

Packets in long form have the columns capture_id, axis, arrival_ix, fs, values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import Ordered

KEY = ("capture_id", "axis", "session_id")


def by_axis(packets: DataFrame) -> DataFrame:
    """Three-axis packets in long form."""
    axes = F.explode(F.create_map(*(c for a in "xyz" for c in (F.lit(a), F.col(a)))))
    return packets.select("capture_id", "arrival_ix", "fs", axes.alias("axis", "values"))


def assign_sessions(packets: DataFrame, packets_per_session: int, numbered: bool = False) -> DataFrame:
    """session_id from 1: every packets_per_session packets in order of arrival; a rest is dropped.

    numbered: arrival_ix counts an axis's packets from 0 without gaps, as read_captures gives it, so
    a session follows from it; else packets are first put in order (`Ordered`)."""
    turn = F.col("arrival_ix")
    if not numbered:
        packets, turn = Ordered(packets, ["capture_id", "axis"], ["arrival_ix"]).placed("_turn"), F.col("_turn")
    with_session = packets.withColumn("session_id", (F.floor(turn / packets_per_session) + 1).cast("int")).drop("_turn")
    whole = F.count("*").over(W.partitionBy(*KEY)) == packets_per_session
    return with_session.withColumn("_whole", whole).where("_whole").drop("_whole")


def demeaned(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(values, lambda x: x - mean)


def signals(sessions: DataFrame) -> DataFrame:
    """One row a session and axis: fs (mean over packets), samples, duration, signal (joined, demeaned).

    Rates are added in sorted order, so axes of equal rates get one mean to the last bit however
    their packets are dealt over tasks; `align` asks for equal frequencies."""
    ordered = F.array_sort(F.collect_list(F.struct("arrival_ix", "values")))
    joined = F.flatten(F.transform(ordered, lambda p: p["values"]))
    rates = F.array_sort(F.collect_list(F.col("fs").cast("double")))  # without nulls, as in a mean
    fs = F.try_divide(F.aggregate(rates, F.lit(0.0), lambda a, x: a + x), F.size(rates))
    out = sessions.groupBy(*KEY).agg(fs.alias("fs"), joined.alias("raw"))
    samples = F.size("raw")
    return out.select(*KEY, "fs", samples.cast("long").alias("samples"), (samples / F.col("fs")).alias("duration"), demeaned(F.col("raw")).alias("signal"))


def samples(signal_rows: DataFrame) -> DataFrame:
    """Signals in long form: i from 0, value."""
    return signal_rows.select(*KEY, F.posexplode("signal").alias("i", "value"))


def progress(packets: DataFrame) -> DataFrame:
    """Running packet count, mean fs and duration (by the latest packet's length) after each packet."""
    running = Ordered(packets, ["capture_id", "axis"], ["arrival_ix"]).running("_turn", _fs="fs")
    count, fs = F.col("_turn") + 1, F.col("_fs") / (F.col("_turn") + 1)
    return running.select("capture_id", "axis", "arrival_ix", count.alias("packets"), fs.alias("mean_fs"), (count * F.size("values") / fs).alias("duration"))


def enough_sessions(sessions: DataFrame, least: int) -> DataFrame:
    """Sessions a capture and axis has, and whether they are as many as recommended; nothing is dropped."""
    n = F.countDistinct("session_id")
    return sessions.groupBy("capture_id", "axis").agg(n.alias("sessions"), (n >= least).alias("recommended"))
