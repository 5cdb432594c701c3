"""Progress of a recording: packets, mean sampling rate and duration so far, outside the data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "packet_progress"


def observed(packets: DataFrame) -> DataFrame:
    """packets (batch or stream), with their count, rates and latest length as observed metrics.

    They are gathered in the pass that reads the packets anyway."""
    return packets.observe(
        NAME, F.count(F.lit(1)).alias("packets"), F.sum("fs").alias("fs_sum"), F.max(F.struct("arrival_ix", "n")).alias("latest")
    )


@dataclass(frozen=True)
class Progress:
    packets: int = 0
    mean_fs: float = 0.0
    duration: float = 0.0


class ProgressListener(StreamingQueryListener):
    """Adds up the observed metrics of all batches; spark.streams.addListener(ProgressListener()).

    duration is packets times the latest packet's samples over the mean rate.  `tell`, if
    given, gets each new Progress, as a recording's console line would.  One listener is for one query."""

    def __init__(self, tell: Callable[[Progress], None] | None = None):
        self.tell, self.now, self.stopped = tell, Progress(), False
        self._fs_sum = 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is None or not row["packets"]:
            return
        self._fs_sum += row["fs_sum"]
        packets = self.now.packets + row["packets"]
        mean = self._fs_sum / packets
        self.now = Progress(packets, mean, packets * row["latest"]["n"] / mean)
        if self.tell:
            self.tell(self.now)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.stopped = True
