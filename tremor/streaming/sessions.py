"""Count windows over a stream of packets, with state by capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import stop

_PACKET = "arrival_ix long, fs double, x array<double>, y array<double>, z array<double>"
SESSION_PACKETS = f"capture_id string, session_id int, {_PACKET}"


class _Sessions(StatefulProcessor):
    """Packets of the open session, and the number of the next one."""

    def __init__(self, packets_per_session: int, stop_file: str | None):
        self.size, self.stop_file = packets_per_session, stop_file

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _PACKET)
        self.next = handle.getValueState("next", "session_id int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _PACKET.split(", ")]
        new = pd.concat(list(rows))[columns].sort_values("arrival_ix")
        held = [*(self.held.get() or []), *new.itertuples(index=False, name=None)]
        number = self.next.get()[0] if self.next.exists() else 1
        end = stop.requested(self.stop_file, key[0])  # sessions that begin from there on are not wanted
        while len(held) >= self.size and (end is None or held[0][0] < end):
            out = pd.DataFrame(held[: self.size], columns=columns)
            out["arrival_ix"] = range((number - 1) * self.size, number * self.size)  # the capture's packets from 0
            out.insert(0, "session_id", number)
            out.insert(0, "capture_id", key[0])
            yield out
            held, number = held[self.size :], number + 1
        if end is not None and held and held[0][0] >= end:
            held = []
        if self.stop_file:
            stop.note(self.stop_file, key[0], len(held))
        self.next.update((number,))
        if held:
            self.held.put([(int(a), float(f), *(list(map(float, v)) for v in axes)) for a, f, *axes in held])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def session_packets(packets: DataFrame, packets_per_session: int, stop_file: str | None = None) -> DataFrame:
    """Streaming packets with session_id, once their session is whole, and arrival_ix from 0.

    An open session stays in the checkpoint, so a stopped query goes on where it was.  With a
    stop_file, streaming.stop can ask for the end after the session that is open.  Packets of a
    capture that one micro-batch brings are held in memory (bytesPerBatch of the source bounds
    them).  Needs the RocksDB state store."""
    return packets.groupBy("capture_id").transformWithStateInPandas(
        statefulProcessor=_Sessions(packets_per_session, stop_file), outputStructType=SESSION_PACKETS, outputMode="Append", timeMode="None"
    )
