"""Capture files as Spark sources, batch and streaming, read in byte ranges by the executors.

Register CaptureSource; then spark.read.format("vib2") or spark.readStream.format("vib2"):

* path: a file, a folder of files, or anything that pyarrow.fs.FileSystem.from_uri opens.
* table: "packets" (default), or "frames", everything a capture holds by its place: packets
  without samples, malformed frames and bytes of no frame, each with a reason.
* rangeBytes: bytes of a range (32 MB).  A range reads a few MB before it to find its first
  frame (framing.synchronised), so ranges do not wait for each other and nothing but sizes of
  files is read on the driver.
* resync: "reference" or "search".
* bytesPerBatch, for streams: how far a capture moves on in a micro-batch, at most (no limit;
  leave it out with availableNow, which ends after one batch; a restart's first batch has none).

A file is opened for a range and closed with it, so a stopped reader leaves nothing open.

In packets, arrival_ix is the byte at which the frame begins: it orders a capture's packets.
`read_captures` numbers them from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window as W

from .framing import COUNTS_PER_G, HEAD, encode, find_frame, frames, pieces  # noqa: F401

PACKETS = "capture_id string, arrival_ix long, n int, elapsed_us long, sequence long, fs double, x array<double>, y array<double>, z array<double>"
FRAMES = "capture_id string, range_ix long, place long, length long, n int, elapsed_us long, sequence long, reason string"
#: Samples of an Arrow batch: 4 MB a column.
_SAMPLES = 1 << 19


@dataclass
class Range(InputPartition):
    """Bytes start..end of a capture; whole: end is where the capture ends."""

    path: str
    index: int
    start: int
    end: int
    whole: bool


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the captures, by path; names that begin with . or _ are no captures."""
    store, root = _store(path)
    info = store.get_file_info(root)
    found = store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
    uri = urlsplit(path) if "://" in path else None
    # paths of a store either begin with its host or bucket, or leave it out
    ahead = "" if uri is None else f"{uri.scheme}://{uri.netloc if found and found[0].path.startswith('/') else ''}"
    return sorted((ahead + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")


def _ranges(path: str, start: int, end: int, size: int, whole: bool) -> list[Range]:
    cuts = [*range(start, end, size), end]
    return [Range(path, a // size, a, b, whole and b == end) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _Read:
    """What the readers share: the options, and the rows of a range."""

    def __init__(self, options: dict):
        self.path, self.resync = options["path"], options.get("resync", "reference")
        self.table = options.get("table", "packets")
        self.size = int(options.get("rangeBytes", str(32 << 20)))

    def rows(self, part: Range, streaming: bool) -> Iterator[pa.RecordBatch]:
        store, path = _store(part.path)
        name = part.path.rsplit("/", 1)[-1]
        with store.open_input_file(path) as f:
            size = part.end if streaming else f.size()  # what comes after a batch's end is not this batch's

            def read(a: int, b: int) -> bytes:
                return f.read_at(max(0, min(b, size) - a), a)

            found = pieces(read, part.start, part.end, self.resync, part.whole)
            if self.table == "frames":
                yield from self._frames(name, part.index, (p for p, _ in found if not streaming or p.reason != "no frame"))
            else:
                yield from self._packets(name, ((p, d) for p, d in found if p.packet))

    def _frames(self, name: str, index: int, found) -> Iterator[pa.RecordBatch]:
        held = []
        for p in found:
            held.append((name, index, p.start, p.end - p.start, p.n, p.elapsed_us, p.sequence, p.reason))
            if len(held) == 1 << 14:
                yield self._batch(FRAMES, held)
                held = []
        if held:
            yield self._batch(FRAMES, held)

    @staticmethod
    def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        names = [c.split() for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])

    def _packets(self, name: str, found) -> Iterator[pa.RecordBatch]:
        held, samples = [], 0
        for p, data in found:
            held.append((p, np.frombuffer(data, "<i4", 3 * p.n, HEAD).reshape(3, p.n)))
            samples += p.n
            if samples >= _SAMPLES:
                yield self._decoded(name, held)
                held, samples = [], 0
        if held:
            yield self._decoded(name, held)

    @staticmethod
    def _decoded(name: str, held: list) -> pa.RecordBatch:
        n = np.array([p.n for p, _ in held], np.int32)
        elapsed = np.array([p.elapsed_us for p, _ in held], np.int64)
        offset = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        axes = [pa.ListArray.from_arrays(offset, pa.array(np.concatenate([v[k] for _, v in held]) / COUNTS_PER_G)) for k in range(3)]
        columns = [
            pa.array([name] * len(held)), pa.array([p.start for p, _ in held], pa.int64()), pa.array(n), pa.array(elapsed),
            pa.array([p.sequence for p, _ in held], pa.int64()), pa.array((n - 1) / elapsed * 1e6), *axes,
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKETS.split(", ")])


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.of = _Read(options)

    def partitions(self) -> list[Range]:
        return [r for path, size in _files(self.of.path) for r in _ranges(path, 0, size, self.of.size, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # no capture at all
            yield from self.of.rows(partition, False)


class _Stream(DataSourceStreamReader):
    """Offsets are bytes of each capture; a frame comes with the batch that holds its last byte.

    So a cut frame waits for more bytes, junk of any length is passed over, and a batch that
    is read again gives the same rows.
    """

    def __init__(self, options: dict):
        self.of, self.most = _Read(options), int(options.get("bytesPerBatch", 1 << 62))
        self.at: dict[str, int] | None = None  # what was planned; unknown in a restarted query

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        files = _files(self.of.path)
        return {path: size if self.at is None else min(size, self.at.get(path, 0) + self.most) for path, size in files}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = dict(end)
        return [r for path, until in sorted(end.items()) for r in _ranges(path, start.get(path, 0), until, self.of.size, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.of.rows(partition, True)

    def stop(self) -> None:
        self.at = None


class CaptureSource(DataSource):
    """spark.dataSource.register(CaptureSource); format "vib2"."""

    @classmethod
    def name(cls) -> str:
        return "vib2"

    def schema(self) -> str:
        table = self.options.get("table", "packets")
        if table not in ("packets", "frames"):
            raise ValueError(f"table is packets or frames, not {table}")
        return PACKETS if table == "packets" else FRAMES

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("vib2").options(path=path, **{k: str(v) for k, v in options.items() if v is not None}).load()


def frame_table(spark: SparkSession, path: str, resync: str = "reference", range_bytes: int | None = None) -> DataFrame:
    """All that captures hold, by place: packets (no reason) and what was left out, with its reason:
    "fewer than two samples", "no elapsed time", "cut off" (at the end), "no frame".

    The lengths of a capture's rows add up to its size; bytes of no frame are cut where a range ends."""
    return _load(spark, path, table="frames", resync=resync, rangeBytes=range_bytes)


def quarantine(spark: SparkSession, path: str, resync: str = "reference", range_bytes: int | None = None) -> DataFrame:
    """capture_id, place, length, n, elapsed_us, sequence, reason of what `read_captures` leaves out."""
    return frame_table(spark, path, resync, range_bytes).where("reason is not null").drop("range_ix")


def read_captures(spark: SparkSession, path: str, resync: str = "reference", range_bytes: int | None = None) -> DataFrame:
    """Packets of capture files, the file name as capture_id, arrival_ix from 0 in each.

    Files may be larger than memory and than 2 GB: ranges are read in parallel, in bounded
    batches.  A range's first number is the packets of the ranges before it, counted from
    headers alone.  Malformed packets are left out (`quarantine`)."""
    size = range_bytes or 32 << 20
    packets = _load(spark, path, resync=resync, rangeBytes=size)
    of_range = F.floor(F.col("place") / size)  # by where a frame begins, which both tables know
    counts = frame_table(spark, path, resync, size).where("reason is null").groupBy("capture_id", of_range.alias("_range")).agg(F.count("*").alias("_many"))
    ahead = W.partitionBy("capture_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("capture_id", "_range", F.coalesce(F.sum("_many").over(ahead), F.lit(0)).alias("_before"))  # a row a range
    inside = F.row_number().over(W.partitionBy("capture_id", "_range").orderBy("arrival_ix")) - 1
    placed = packets.withColumn("_range", F.floor(F.col("arrival_ix") / size)).join(before, ["capture_id", "_range"])
    return placed.withColumn("arrival_ix", F.col("_before") + inside).select(*packets.columns)
