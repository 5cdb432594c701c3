"""Framed packets of a three-axis accelerometer.

A frame is the magic, a header of four little-endian fields (samples N as u16, a reserved
u16, elapsed microseconds and a sequence number as u32) and 3 * N little-endian i32 counts,
all of X, then Y, then Z.  This module finds and decodes frames in any byte range of a
capture; sources.wire makes Spark sources of it.

A range a..b gives the frames that end inside it, so ranges side by side give every frame once.
Where a reader at the beginning of the capture would stand at byte a depends on all bytes
before a, as it skips over whole frames and, after a stray V, over three bytes more.  But a
few frames back it is nearly always the same wherever one starts: `synchronised` maps every
possible entry of a window before a to its exit, and takes a longer window until all entries
have one exit.  No range needs another's result, and nobody has to read a capture in one go.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"VIB2"
HEADER = struct.Struct("<HHII")
#: Bytes of magic and header, and of the longest frame.
HEAD = len(MAGIC) + HEADER.size
LONGEST = HEAD + 12 * 65535
COUNTS_PER_G = 256_000.0
#: Further than any byte: where a frame ends whose header is not there yet.
_OPEN = 1 << 62


def find_frame(data: bytes, at: int, resync: str = "reference") -> int:
    """Place after the next magic, or -1.

    reference: a V takes the three bytes after it along, also when they are not the rest of
    the magic, so a frame right behind a stray V is lost.  search: any magic counts.
    """
    if resync == "search":
        found = data.find(MAGIC, at)
        return found + len(MAGIC) if found >= 0 else -1
    while (at := data.find(MAGIC[:1], at)) >= 0:
        if data[at : at + 4] == MAGIC:
            return at + 4
        at += 4
    return -1


def frames(data: bytes, resync: str = "reference") -> Iterator[tuple[int, tuple | None]]:
    """(end of the frame, packet fields), fields None for a malformed packet; stops at a cut one.

    fs needs two samples and some time; other packets count as malformed.
    """
    at = 0
    while (start := find_frame(data, at, resync)) >= 0:
        body = start + HEADER.size
        if body > len(data):
            return
        n, _, elapsed, sequence = HEADER.unpack_from(data, start)
        at = body + 12 * n
        if at > len(data):
            return
        if n < 2 or not elapsed:
            yield at, None
            continue
        values = np.frombuffer(data, "<i4", 3 * n, body) / COUNTS_PER_G
        yield at, (n, elapsed, sequence, (n - 1) / elapsed * 1e6, *(values[k * n : (k + 1) * n].tolist() for k in range(3)))


def encode(x, y, z, elapsed_us: int, sequence: int = 0) -> bytes:
    """A frame of integer counts, for replays and tests."""
    body = np.concatenate([x, y, z]).astype("<i4").tobytes()
    return MAGIC + HEADER.pack(len(x), 0, elapsed_us, sequence) + body


def marks(data: bytes, resync: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a scan of data may stop: places, where it goes on from there, and which are frames.

    reference: every V; one that is no magic sends the scan four bytes on.  search: every magic.
    A V too near the end to tell, and a frame without its header, lead to _OPEN."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(b == MAGIC[0])
    known = at[at + len(MAGIC) <= len(b)]
    magic = np.ones(len(known), bool)
    for k in range(1, len(MAGIC)):
        magic &= b[known + k] == MAGIC[k]
    on = np.full(len(at), _OPEN, np.int64)
    on[: len(known)] = known + len(MAGIC)
    head = np.flatnonzero(magic)
    whole = head[known[head] + HEAD <= len(b)]
    on[head] = _OPEN
    n = b[known[whole] + len(MAGIC)].astype(np.int64) + 256 * b[known[whole] + len(MAGIC) + 1].astype(np.int64)
    on[whole] = known[whole] + HEAD + 12 * n
    frame = np.zeros(len(at), bool)
    frame[head] = True
    if resync == "search":
        keep = frame | (np.arange(len(at)) >= len(known))
        return at[keep], on[keep], frame[keep]
    return at, on, frame


def exits(at: np.ndarray, on: np.ndarray, stop: int) -> np.ndarray:
    """For each mark before `stop`, the first place from `stop` on that a scan beginning there
    comes to; and last, for a scan that meets no mark."""
    at, on = at[at < stop], on[at < stop]
    here = np.arange(len(at) + 1)
    out = np.append(on, stop)
    to = np.where(out < stop, np.searchsorted(at, out), here)
    while np.any(to[to] != to):  # each round doubles the marks passed over
        to = to[to]
    return out[to]


def synchronised(read: Callable[[int, int], bytes], a: int, resync: str) -> int:
    """The first place from a on where a scan of the capture from its beginning looks for a frame.

    read(from, to) gives bytes of the capture, fewer at its end.  Every scan enters the first
    LONGEST bytes of a window somewhere; if all entries there leave it at one place, what lies
    before does not matter.
    """
    width = 2 * LONGEST
    while True:
        lo = max(0, a - width)
        at, on, _ = marks(read(lo, a + HEAD), resync)
        out = exits(at, on, a - lo)
        last = 0 if lo == 0 else int(np.searchsorted(at[at < a - lo], LONGEST - 1))
        if np.all(out[: last + 1] == out[0]):
            return lo + int(out[0])
        width *= 2


@dataclass(frozen=True)
class Piece:
    """Bytes start..end of a capture: a frame (with its header's fields), or what is none."""

    start: int
    end: int
    n: int = 0
    elapsed_us: int = 0
    sequence: int = 0
    reason: str | None = None

    @property
    def packet(self) -> bool:
        return self.reason is None


def pieces(read: Callable[[int, int], bytes], a: int, b: int, resync: str = "reference", last: bool = False) -> Iterator[tuple[Piece, bytes]]:
    """What a range of a capture holds, in order, with its bytes: the frames that end in a+1..b,
    malformed ones with a reason, and the bytes in a..b that belong to no frame (reason "no frame").

    last: b is the end of the capture, where a frame that is cut off gets the reason "cut off".
    """
    lo = max(0, a - LONGEST)  # a frame that ends inside the range begins behind it
    at = synchronised(read, lo, resync) if lo else 0
    data = read(lo, b + len(MAGIC))
    limit = min(b - lo, len(data))
    where, on, frame = marks(data, resync)
    place, junk = at - lo, max(at, a) - lo  # of the scan, and of the first byte that is in no frame so far

    def loose(until: int) -> Iterator[tuple[Piece, bytes]]:
        if until > junk:
            yield Piece(lo + junk, lo + until, reason="no frame"), data[junk:until]

    while (k := int(np.searchsorted(where, place))) < len(where) and where[k] < limit:
        start, place = int(where[k]), int(on[k])
        if not frame[k]:
            if place == _OPEN:  # at the end of the capture
                break
            continue
        if place > limit:
            yield from loose(start)
            junk = limit
            if last:
                yield Piece(lo + start, lo + limit, reason="cut off"), data[start:limit]
            break
        n, _, elapsed, sequence = HEADER.unpack_from(data, start + len(MAGIC))
        if lo + place > a:
            yield from loose(start)
            reason = "fewer than two samples" if n < 2 else "no elapsed time" if not elapsed else None
            yield Piece(lo + start, lo + place, n, elapsed, sequence, reason), data[start:place]
        junk = max(junk, place)
    yield from loose(limit)
