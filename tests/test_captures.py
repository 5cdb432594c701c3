"""Captures in byte ranges, batch and streaming, against a byte-by-byte reader."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.sources import framing, wire
from tremor.streaming import progress, stop
from tremor.streaming.sessions import session_packets


def reader(data, resync):
    """The frames of a capture as a reader from its first byte meets them: (start, end, good), and where it is stuck."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 1] != b"V":
            at += 1
        elif len(data) - at < 4:
            return out, None
        elif data[at : at + 4] != b"VIB2":
            at += 4 if resync == "reference" else 1
        else:
            n = int.from_bytes(data[at + 4 : at + 6], "little")
            end = at + 16 + 12 * n
            if at + 16 > len(data) or end > len(data):
                return out, at
            out.append((at, end, n >= 2 and data[at + 8 : at + 12] != bytes(4)))
            at = end
    return out, None


def messy(seed, packets=60, short=False):
    """Frames with junk, stray V's, magics inside payloads, malformed and cut frames; short: every magic has 9 samples at most."""
    r, out = np.random.default_rng(seed), []
    for k in range(packets):
        n = int(r.integers(0, 9))
        x = r.integers(-(2**31), 2**31, (3, n))
        if n and r.random() < 0.3:
            x[int(r.integers(0, 3)), int(r.integers(0, n))] = int.from_bytes(r.choice([b"VIB2", b"VVVV", b"xVIB"]), "little", signed=True)
        frame = framing.encode(*x, int(r.integers(0, 3)) * 500, k)
        if r.random() < 0.15:
            frame = frame[: int(r.integers(1, len(frame) + 1))]
        out += [frame, bytes(r.choice(list(b"VIB2x\0"), int(r.integers(0, 12))).astype(np.uint8).tobytes()) if r.random() < 0.4 else b""]
    data = bytearray(b"".join(out))
    at = -1
    while short and 0 <= (at := data.find(b"VIB2", at + 1)) < len(data) - 6:
        data[at + 4 : at + 6] = bytes([data[at + 4] % 10, 0])
    return bytes(data)


@pytest.mark.parametrize("resync", ["reference", "search"])
@pytest.mark.parametrize("longest", [framing.LONGEST, 130])
def test_any_ranges_give_what_one_reader_meets(resync, longest, monkeypatch):
    """With frames known to be short, synchronisation works on windows of a few hundred bytes."""
    monkeypatch.setattr(framing, "LONGEST", longest)
    for seed in range(25):
        data = messy(seed, short=longest == 130)
        want, stuck = reader(data, resync)
        read = lambda a, b: data[max(0, a) : max(0, b)]  # noqa: E731, B023
        for size in (64, 137, 1000, len(data)):
            got = [p for a in range(0, len(data), size) for p, d in framing.pieces(read, a, min(a + size, len(data)), resync, a + size >= len(data)) if d is not None]
            assert [(p.start, p.end, p.packet) for p in got if p.reason not in ("no frame", "cut off")] == want
            assert [p.start for p in got if p.reason == "cut off"] == ([stuck] if stuck is not None else [])
            covered = sorted((p.start, p.end) for p in got)
            assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40).map(lambda b: b.replace(b"\xff", b"V").replace(b"\xfe", b"VIB2")), st.integers(1, 9), st.sampled_from(["reference", "search"]))
def test_exits_agree_with_a_scan(data, stop_at, resync):
    at, on, _ = framing.marks(data, resync)
    out = framing.exits(at, on, stop_at)
    for k, start in enumerate(at[at < stop_at]):
        place = int(start)
        while place < stop_at:
            later = at[at >= place]
            place = int(on[np.searchsorted(at, place)]) if len(later) and later[0] < stop_at else stop_at
        assert out[k] == place
    assert out[-1] == stop_at


def capture(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def test_a_capture_in_many_ranges_equals_one(spark, tmp_path):
    data = messy(101, 400)
    path = capture(tmp_path / "in", "a.bin", data)
    capture(tmp_path / "in", "b.bin", messy(102))
    capture(tmp_path / "in", "empty.bin", b"")
    for resync in ("reference", "search"):
        one = sorted(map(tuple, wire.read_captures(spark, path, resync).collect()))
        many = sorted(map(tuple, wire.read_captures(spark, path, resync, range_bytes=len(data) // 200).collect()))
        want, stuck = reader(data, resync)
        mine = [r for r in one if r[0] == "a.bin"]
        assert one == many and [r[1] for r in mine] == list(range(sum(good for *_, good in want)))
        assert [r[2:6] for r in mine] == [p[:4] for _, p in framing.frames(data, resync) if p]
        assert [(r[6], r[7], r[8]) for r in mine] == [p[4:] for _, p in framing.frames(data, resync) if p]
        for size in (None, 97):
            bad = wire.quarantine(spark, path, resync, size).where("capture_id = 'a.bin'").collect()
            assert sum(r.reason in ("fewer than two samples", "no elapsed time") for r in bad) == sum(not good for *_, good in want)
            whole = wire.frame_table(spark, path, resync, size).where("capture_id = 'a.bin'").collect()
            assert sum(r.length for r in whole) == len(data) and sum(r.reason is None for r in whole) == len(mine)
            assert [r.place for r in bad if r.reason == "cut off"] == ([stuck] if stuck is not None else [])
    with pytest.raises(Exception, match="packets or frames"):
        spark.read.format("vib2").option("path", path).option("table", "x").load()
    assert wire.read_captures(spark, capture(tmp_path / "none", "empty.bin", b"")).count() == 0


def stream(spark, path, tmp_path, name, packets=4, stop_file=None, listener=False, trigger=None, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(wire.CaptureSource)
    source = spark.readStream.format("vib2").options(path=path, **options).load()
    source = progress.observed(source) if listener else source
    out = session_packets(source, packets, stop_file).writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
    return out.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(**(trigger or {"availableNow": True})).start()


def sessions_of(spark, tmp_path, name):
    rows = spark.read.parquet(f"{tmp_path}/{name}").collect()
    return sorted((r.capture_id, r.session_id, r.arrival_ix, r.fs, r.x, r.y, r.z) for r in rows)


def expected(name, data, packets):
    good = [p for _, p in framing.frames(data, "reference") if p]
    return [(name, k // packets + 1, k, p[3], *p[4:]) for k, p in enumerate(good[: len(good) // packets * packets])]


def test_stream_in_ranges_gives_the_sessions_of_batch(spark, tmp_path):
    data, other = messy(7, 150), messy(8, 40)
    path = capture(tmp_path / "in", "a", data[:1500])
    capture(tmp_path / "in", "b", other)
    stream(spark, path, tmp_path, "out", rangeBytes="64").awaitTermination(120)
    capture(tmp_path / "in", "a", data)  # the capture goes on where a frame was cut
    stream(spark, path, tmp_path, "out", rangeBytes="1000").awaitTermination(120)
    assert sessions_of(spark, tmp_path, "out") == sorted(expected("a", data, 4) + expected("b", other, 4))


def test_junk_longer_than_a_batch_is_passed_over(spark, tmp_path):
    frame = lambda k: framing.encode([k] * 4, [k] * 4, [k] * 4, 1000, k)
    data = frame(0) + b"junk V..." * 240_000 + frame(1)
    path = capture(tmp_path / "in", "a", data)
    q = stream(spark, path, tmp_path, "out", packets=2, trigger={"processingTime": "0 seconds"}, bytesPerBatch=str(1 << 20))
    q.processAllAvailable()
    q.stop()
    assert [r[:3] for r in sessions_of(spark, tmp_path, "out")] == [("a", 1, 0), ("a", 1, 1)] == [r[:3] for r in expected("a", data, 2)]


def test_progress_and_stop_after_the_open_session(spark, tmp_path):
    frame = lambda k: framing.encode([k] * (4 + k), [k] * (4 + k), [k] * (4 + k), 1000, k)
    path = capture(tmp_path / "in", "a", b"".join(map(frame, range(6))))
    heard = progress.ProgressListener()
    spark.streams.addListener(heard)
    stop_file = str(tmp_path / "stop")
    q = stream(spark, path, tmp_path, "out", packets=4, stop_file=stop_file, listener=True, trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        wait = time.monotonic() + 30
        while heard.now.packets < 6 and time.monotonic() < wait:
            time.sleep(0.1)
        fs = [(3 + k) / 1000 * 1e6 for k in range(6)]
        assert heard.now.packets == 6 and heard.now.mean_fs == pytest.approx(np.mean(fs)) and heard.now.duration == pytest.approx(6 * 9 / np.mean(fs))
        stop.request(q, stop_file)  # two packets of the second session are there
        capture(tmp_path / "in", "a", b"".join(map(frame, range(14))))
        assert stop.after_session(q, stop_file, 60) == [] and not q.isActive
        while not heard.stopped and time.monotonic() < wait:
            time.sleep(0.1)
        assert heard.stopped
    finally:
        spark.streams.removeListener(heard)
    assert [r[1:3] for r in sessions_of(spark, tmp_path, "out")] == [(k // 4 + 1, k) for k in range(8)]


def test_a_range_closes_its_file(tmp_path, monkeypatch):
    path, opened = capture(tmp_path / "in", "a", messy(1)) + "/a", []

    class Store:
        def open_input_file(self, at):
            opened.append(wire.fs.LocalFileSystem().open_input_file(at))
            return opened[-1]

    monkeypatch.setattr(wire, "_store", lambda p: (Store(), p))
    rows = wire._Read({"path": path}).rows(wire.Range(path, 0, 0, 500, False), True)
    next(rows)
    assert [f.closed for f in opened] == [False]
    rows.close()  # as when a task is killed
    assert [f.closed for f in opened] == [True]


def test_stop_without_an_open_session_is_at_once(spark, tmp_path):
    frame = lambda k: framing.encode([k] * 4, [k] * 4, [k] * 4, 1000, k)
    path = capture(tmp_path / "in", "a", b"".join(map(frame, range(4))))
    stop_file = str(tmp_path / "stop")
    q = stream(spark, path, tmp_path, "out", packets=4, stop_file=stop_file, trigger={"processingTime": "0 seconds"})
    q.processAllAvailable()
    began = time.monotonic()
    assert stop.after_session(q, stop_file, 60) == [] and time.monotonic() - began < 40  # it did not wait for packets
    assert not q.isActive and [r[1:3] for r in sessions_of(spark, tmp_path, "out")] == [(1, k) for k in range(4)]


def test_stop_without_further_packets_keeps_the_open_session(spark, tmp_path):
    """Patience ends; the packets stay in the checkpoint, and a query without the request goes on."""
    frame = lambda k: framing.encode([k] * 4, [k] * 4, [k] * 4, 1000, k)
    path = capture(tmp_path / "in", "a", b"".join(map(frame, range(6))))
    q = stream(spark, path, tmp_path, "out", packets=4, stop_file=str(tmp_path / "stop"), trigger={"processingTime": "0 seconds"})
    q.processAllAvailable()
    assert stop.after_session(q, str(tmp_path / "stop"), 1) == ["a"] and not q.isActive
    capture(tmp_path / "in", "a", b"".join(map(frame, range(9))))
    stream(spark, path, tmp_path, "out", packets=4).awaitTermination(120)
    assert [r[1:3] for r in sessions_of(spark, tmp_path, "out")] == [(k // 4 + 1, k) for k in range(8)]


def test_uris_name_the_same_files(tmp_path):
    path = capture(tmp_path / "in", "a", b"x")
    capture(tmp_path / "in", "_hidden", b"x")
    assert wire._files(path) == [(f"{path}/a", 1)] == wire._files(f"{path}/a") and wire._files(f"file://{path}") == [(f"file://{path}/a", 1)]
    for p, _ in [*wire._files(path), *wire._files(f"file://{path}")]:
        store, at = wire._store(p)
        assert store.get_file_info(at).size == 1
