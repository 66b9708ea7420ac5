"""Audio in streaming state: exact slices, bounded rings, formats in mid-stream, restarts, timers, repeated writes."""

import json
import shutil
import struct
import sys
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark import cloudpickle

from tessitura.sources import frames as logs
from tessitura.streaming import audio, sink
from tessitura.streaming.session import Limits

PUSH = 7680  # 480 ms
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def ramp(first, n):
    return np.arange(first, first + n, dtype="<f4")


def play(pushes, limits=None, model=None):
    """pushes: (ms, intervals[, command]) of a ramp whose samples are their own numbers."""
    stream, at, out = audio.AudioStream(model or audio.Model(limits or Limits())), 0, []
    for seq, p in enumerate(pushes):
        n = p[0] * 16
        out.append(stream.frame(seq, "binary", ramp(at, n).tobytes(), p[1]) if n or len(p) < 3 else [])
        at += n
        if len(p) > 2:
            out[-1] += stream.frame(seq, "text", p[2].encode())
    return stream, out


def heard(out):
    """The audio of each segment, as first and end sample; every slice must be a ramp."""
    parts = [r for rows in out for r in rows if r[1] == "fed" and len(r[-1])]
    for r in parts:
        assert r[-1].tolist() == list(range(r[3], r[4]))
    return [(r[3], r[4]) for r in parts]


def ms(x):
    return x * 16


@pytest.mark.parametrize(
    "pushes,look_back,want",
    [
        ([(1000, [[500, -1]])], 1000, [(ms(500), ms(1000))]),
        ([(480, []), (480, []), (480, [[0, -1]])], 50, [(14560, 3 * PUSH)]),
        ([(480, []), (480, [[500, -1]]), (480, [[-1, 1300]])], 100, [(ms(500), ms(960)), (ms(960), ms(1300))]),
        ([(480, [[100, 400]]), (480, []), (480, [[1000, 1300]])], 1000, [(ms(100), ms(400)), (ms(1000), ms(1300))]),
        ([(480, []), (480, []), (480, [[0, 1440]])], 50, [(14560, ms(1440))]),
        ([(480, []), (480, [[300, -1]])], 1000, [(ms(300), ms(960))]),  # across a chunk's edge
        ([(480, []), (480, [], "eof")], 1000, []),
    ],
)
def test_exact_slices(pushes, look_back, want):
    assert heard(play(pushes, Limits(look_back_ms=look_back))[1]) == want


def test_state_is_bounded_by_the_look_back():
    stream, most = audio.AudioStream(audio.Model(Limits(look_back_ms=500))), 0
    for seq in range(10_000):
        stream.frame(seq, "binary", ramp(seq * 160 % 4096, 160).tobytes(), [[seq * 10.0, -1.0]] if seq % 1000 == 10 else [[-1.0, seq * 10.0]] if seq % 1000 == 500 else [])
        most = max(most, len(stream.ring))
    assert most <= 8000 and len(stream.ring.chunks) <= 51 and len(stream.stored()) < 1000


def test_a_decoder_hears_the_windows_of_its_segment():
    name = lambda x: f"{int(x[0])}-{int(x[-1]) + 1}" if len(x) else ""
    model = audio.Model(Limits(chunk_size=2, max_history=4), name)
    _, out = play([(120, [[0, -1]]), (120, []), (120, []), (120, [[-1, 480]])], model=model)
    assert [(r[1], r[10]) for rows in out for r in rows if r[10] is not None] == [("partial", "0-1920"), ("partial", "0-3840"), ("partial", "0-38403840-5760"), ("final", "0-7680")]


def test_look_back_is_clamped_to_what_is_kept_after_a_long_segment():
    stream, out = play([(1000, [[0, 900]]), (1000, []), (1000, [[500, -1]])], Limits(look_back_ms=1000))
    assert heard(out) == [(0, ms(900)), (ms(1000), ms(3000))]


def test_formats_commands_and_broken_frames():
    stream = audio.AudioStream()
    halves = (np.array([0, 16384, -32768, 32767], "<i2")).tobytes()
    said = [
        stream.frame(0, "open", b"/?format=INT16"),
        stream.frame(1, "binary", halves, [[0, -1]]),
        stream.frame(2, "binary", b"abc"),
        stream.frame(3, "text", b'{"type": "config", "format": "float64"}'),
        stream.frame(4, "text", b' {"type": "CONFIG", "format": "float32"} '),
        stream.frame(5, "binary", np.array([0.25], "<f4").tobytes()),
        stream.frame(6, "binary", b""),
        stream.frame(7, "text", b"dance"),
        stream.frame(8, "binary", None),
        stream.frame(9, "text", b" EOF \n"),
        stream.frame(10, "text", b"reset"),
    ]
    assert [[(r[1], r[7]) for r in rows if r[1] not in ("fed", "final")] for rows in said] == [
        [("ready", "int16")], [("start", None)], [("error", "3 bytes hold no whole int16 samples")], [("error", "no such format: float64")],
        [("config", "float32")], [], [], [("error", "not a command: dance")], [("error", "no audio")], [("end", None), ("eof", None)], [("reset", None)],
    ]
    fed = [x for rows in said for r in rows if r[1] == "fed" for x in r[-1].tolist()]
    assert fed == [0.0, 0.5, -1.0, np.float32(32767) / 32768, 0.25]
    assert stream.state.samples == 0 and not len(stream.ring)


def loud(samples, is_final, memory):
    """A detector: speech where samples aren't zero, on its own clock."""
    at, out = memory.get("at", 0), []
    for x in samples:
        if (x != 0) != memory.get("on", False):
            memory["on"] = not memory.get("on", False)
            out.append([at / 16, -1.0] if memory["on"] else [-1.0, at / 16])
        at += 1
    memory["at"] = at
    return out


def test_a_detector_of_samples_keeps_its_memory():
    model = audio.Model(Limits(detector_clock=True), detect=loud)
    stream, rows = audio.AudioStream(model), []
    quiet, noise = np.zeros(1600, "<f4"), np.full(1600, 0.5, "<f4")
    for seq, block in enumerate([quiet, noise, noise, quiet, noise]):
        rows += stream.frame(seq, "binary", block.tobytes())
        stream = audio.AudioStream(model, stream.stored(), stream.ring.stored())
    rows += stream.frame(9, "text", b"eof")
    rows += stream.frame(10, "binary", noise.tobytes())
    assert [(r[1], r[2]) for r in rows if r[2] is not None] == [("start", 100.0), ("end", 300.0), ("start", 400.0), ("end", 500.0), ("start", 500.0)]


def frames_of(stream, pushes=12):
    """A stream whose format changes in its middle."""
    rng = np.random.default_rng(len(stream))
    out = [("open", b"/?format=int16")]
    for k in range(pushes):
        block = rng.integers(1, 30_000, 1600) * (k % 4 != 0)
        if k == pushes // 2:
            out += [("text", b'{"type":"config","format":"float32"}'), ("binary", b"odd")]
        if k in (3, pushes - 3):
            out.append(("text", b"reset"))
        out.append(("binary", block.astype("<i2").tobytes() if k < pushes // 2 else (block / 32768).astype("<f4").tobytes()))
    return [*out, ("text", b"eof")]


MODEL = audio.Model(Limits(chunk_size=2, max_history=4, look_back_ms=200, detector_clock=True), lambda x: str(round(float(np.abs(x).sum()), 2)), loud)


def plain_rows(stream):
    """The same frames in one process; ``seq`` is the byte position in the log."""
    one, at, out = audio.AudioStream(MODEL), 0, []
    for kind, payload in frames_of(stream):
        out += [(stream, *r) for r in one.frame(at, kind, payload)]
        at += logs.HEADER.size + len(payload)
    return out


def simple(rows):
    return sorted(str(tuple(np.asarray(x, np.float32).tolist() if isinstance(x, (list, np.ndarray)) else x for x in r)) for r in rows)


def test_logs_to_sink_over_restarts_give_each_frame_once(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    whole = {s: logs.encode_frames(frames_of(s)) for s in ("a", "bb", "ccc")}
    done = dict.fromkeys(whole, 0)
    (tmp_path / "logs").mkdir()

    def grow(share):
        for name, data in whole.items():  # cuts fall inside frames: the source waits for the rest
            stop = int(len(data) * share)
            with open(f"{folder}/{name}.frames", "ab") as log:
                log.write(data[done[name] : stop])
            done[name] = stop

    def run():
        rows = audio.stream_audio(logs.read_frames_stream(spark, folder, maxBytesPerBatch="9000", rangeBytes="4000"), model=MODEL)
        query = sink.write_frames(rows, out, checkpoint).start()
        try:
            for _ in range(3):
                query.processAllAvailable()
        finally:
            query.stop()

    for share in (0.37, 0.7, 1.0):
        grow(share)
        run()
    want = [r for s in whole for r in plain_rows(s)]
    got = sink.read_written(spark, out).collect()
    results = sorted((r.stream_id, r.seq, json.loads(r.value)["text"]) for r in got if json.loads(r.value)["type"] in ("partial", "final"))
    assert results == sorted((r[0], r[1], r[8]) for r in want if r[2] in ("partial", "final")) and results
    assert sorted((r.stream_id, json.loads(r.value)["type"]) for r in got if json.loads(r.value)["type"] in ("ready", "config", "eof")) == sorted((r[0], r[2]) for r in want if r[2] in ("ready", "config", "eof"))
    errors = sink.read_written(spark, out, "errors").collect()
    assert [json.loads(r.value)["message"] for r in errors] == ["3 bytes hold no whole float32 samples"] * 3
    # the last micro-batch is done again, as after a driver that died before it could say so
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()
    run()
    again = sink.read_written(spark, out).collect()
    assert sorted((r.stream_id, r.seq, r.value) for r in again) == sorted((r.stream_id, r.seq, r.value) for r in got)


def test_batch_fold_equals_one_process(spark):
    rows = []
    for s in ("a", "bb"):
        at = 0
        for kind, payload in frames_of(s):
            rows.append((s, at, kind, payload))
            at += logs.HEADER.size + len(payload)
    frames = spark.createDataFrame(rows, logs.FRAMES).repartition(5)
    got = audio.fold_audio(frames, model=MODEL).collect()
    assert simple(got) == simple(r for s in ("a", "bb") for r in plain_rows(s))
    assert audio.fold_audio(frames.where("false")).count() == 0


@pytest.mark.parametrize("clock", ["data", "machine"])
def test_an_abandoned_stream_is_closed_by_a_timer(spark, tmp_path, clock):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "stream_id string, seq long, kind string, payload binary, intervals array<array<double>>, ts timestamp"
    noise = (np.arange(1, 7681, dtype="<i2")).tobytes()

    def put(name, rows):
        spark.createDataFrame([(s, q, k, p, i, datetime.fromtimestamp(1_000_000 + t)) for s, q, k, p, i, t in rows], schema).coalesce(1).write.parquet(str(tmp_path / name))
        for part in (tmp_path / name).glob("part-*.parquet"):
            shutil.copy(part, folder / f"{name}.parquet")

    pushes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    own = audio.stream_audio(pushes.withWatermark("ts", "1 second"), idle_ms=5000, event_time="ts") if clock == "data" else audio.stream_audio(pushes, idle_ms=1500)
    query = own.writeStream.format("memory").queryName(f"left_{clock}").outputMode("append").start()
    found = lambda: sorted(((r.stream_id, r.kind, r.seq, r.end_ms) for r in spark.table(f"left_{clock}").collect() if r.kind in ("start", "end", "final")), key=str)

    def wait(rows):
        """With the machine's clock there is always another micro-batch, so results are waited for."""
        for _ in range(100):
            if len(found()) >= rows or query.exception():
                break
            time.sleep(0.2)

    try:
        put("one", [("a", 0, "open", b"/?format=int16", None, 0), ("a", 1, "binary", noise, [[0.0, -1.0]], 0), ("b", 0, "open", b"/?format=int16", None, 0), ("b", 1, "binary", noise, [], 0)])
        wait(1)
        assert found() == [("a", "start", 1, None)]
        if clock == "data":
            put("two", [("c", 0, "text", b"reset", None, 100)])
        wait(3)
        closed = [("a", "end", 1, None), ("a", "final", 1, 480.0), ("a", "start", 1, None)]
        assert found() == closed
        put("three", [("a", 7, "open", b"/?format=int16", None, 200), ("a", 8, "binary", noise, [[100.0, 200.0]], 200)])
        wait(6)
        assert found() == sorted([*closed, ("a", "start", 8, None), ("a", "end", 8, None), ("a", "final", 8, 200.0)], key=str)  # time begins anew
    finally:
        query.stop()


def test_whole_frames_and_ranges(tmp_path):
    data = logs.encode_frames([("text", b"abc"), ("binary", b"x" * 100), ("open", b"")])
    (tmp_path / "s.frames").write_bytes(data + struct.pack("<BQ", 0, 50) + b"half")
    reader = logs.FrameReader({"path": str(tmp_path), "rangebytes": "20"})
    end = reader.latestOffset()
    assert end == {"s.frames": len(data)}
    parts = reader.partitions({}, end)
    assert len(parts) == 2 and [(x[1], x[2]) for p in parts for x in reader.read(p)] == [(0, "text"), (12, "binary"), (121, "open")]
    logs.append_frames(str(tmp_path), "t", [("text", b"eof")])
    assert logs.FrameReader({"path": str(tmp_path)}).latestOffset()["t.frames"] == 12
    assert logs.FrameReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_short_ranges_of_many_logs_are_one_partition(tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.frames").write_bytes(logs.encode_frames([("open", b"x" * k), ("binary", b"abcd")]))
    (tmp_path / "long.frames").write_bytes(logs.encode_frames([("binary", b"y" * 9000)] * 5))
    reader = logs.FrameReader({"path": str(tmp_path), "rangebytes": "20000"})
    end = reader.latestOffset()
    parts = reader.partitions({"7.frames": 16}, end)
    assert len(parts) < 10 and all(len(p.ranges) <= logs.LOGS_A_TASK for p in parts)
    got = sorted((x[0], x[1], len(x[3])) for p in parts for x in reader.read(p))
    want = [(str(k), at, size) for k in range(300) for at, size in ((0, k), (9 + k, 4)) if (k, at) != (7, 0)] + [("long", 9009 * k, 9000) for k in range(5)]
    assert got == sorted(want) and end["long.frames"] == 5 * 9009


def test_short_pushes_are_one_chunk_of_state():
    ring = audio.Ring({0: np.arange(4, dtype="<f4").tobytes()})
    for first in range(4, 40_000, 2):
        ring.append(first, np.array([first, first + 1], "<f4"))
    stored = ring.stored({0})
    assert list(stored) == [0, 4, 4 + audio.CHUNK, 4 + 2 * audio.CHUNK]
    assert (audio.Ring(stored).slice(0, 40_000) == np.arange(40_000)).all()
