"""Stop a recording after the session that is open.

A request is a small file in a folder that driver and executors share.  It holds, for each
capture, the byte up to which packets had been read; a session that begins before it is
finished, one that begins later is dropped.  Files beside it say how many packets of a
capture's open session are held, none if no session is open or the last one is finished.
"""

from __future__ import annotations

import json
import time
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.streaming import StreamingQuery

from tremor.sources.wire import _store


def _read(path: str) -> bytes | None:
    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    store, at = _store(path)
    with store.open_output_stream(at) as f:
        f.write(data)


def _mark(stop_file: str, capture: str) -> str:
    return f"{stop_file}.{quote(capture, safe='')}"


def requested(stop_file: str | None, capture: str) -> int | None:
    """The byte from which no session of the capture may begin, or nothing if nobody asked to stop.
    A capture that the request does not know had not begun, and gives no session."""
    said = _read(stop_file) if stop_file else None
    return None if said is None else json.loads(said).get(capture, 0)


def note(stop_file: str, capture: str, held: int) -> None:
    """Packets of the capture's open session, after a micro-batch."""
    _write(_mark(stop_file, capture), str(held).encode())


def is_open(stop_file: str, capture: str) -> bool:
    return _read(_mark(stop_file, capture)) not in (None, b"0")


def request(query: StreamingQuery, stop_file: str) -> dict[str, int]:
    """Ask for the end; returns the byte up to which each capture had been read.  The first request stands."""
    if (said := _read(stop_file)) is not None:
        return json.loads(said)
    ends = [source["endOffset"] for p in query.recentProgress for source in json.loads(p.json)["sources"][:1]]
    offset = next((e for e in reversed(ends) if e), {})
    offset = json.loads(offset) if isinstance(offset, str) else offset
    at = {path.rsplit("/", 1)[-1]: until for path, until in offset.items()}
    _write(stop_file, json.dumps(at).encode())
    return at


def _batches(query: StreamingQuery) -> int:
    last = query.lastProgress
    return -1 if last is None else last.batchId


def after_session(query: StreamingQuery, stop_file: str, patience: float = 60.0) -> list[str]:
    """Ask for the end, wait until each capture has finished the session that is open, if one is,
    and stop the query, which closes the reader.

    Returns the captures that had not finished when `patience` seconds without a finished one
    were over, for want of packets; their open sessions stay in the checkpoint."""
    open_ = {c for c in request(query, stop_file) if is_open(stop_file, c)}
    until = time.monotonic() + patience
    while open_ and query.isActive and time.monotonic() < until:
        time.sleep(0.2)
        done = {c for c in open_ if not is_open(stop_file, c)}
        if done:
            open_ -= done
            until = time.monotonic() + patience
    # tasks say how they stand before their batch is committed: let it end
    batches = _batches(query)
    until = time.monotonic() + patience
    while query.isActive and query.status["isTriggerActive"] and _batches(query) == batches and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()
    return sorted(open_)
