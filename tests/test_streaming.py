"""Scripted traces of the session fold, in batch and as a streaming query."""

import json
import shutil

import pytest

from tessitura.sources import manifests
from tessitura.streaming import jobs
from tessitura.streaming.session import Limits, State, detector_samples, frames_text, step, with_fallback

SHORT = Limits(segment_ms=1000.0)


def trace(pushes, limits=None):
    """pushes: (ms, intervals[, final[, control]]); the rows of each push."""
    state, out = State(), []
    for seq, p in enumerate(pushes):
        state, rows = step(state, seq, round(p[0] * 16), p[1], p[2] if len(p) > 2 else False, p[3] if len(p) > 3 else None, limits or Limits())
        out.append(rows)
    return out


def events(pushes, limits=None):
    return [[f"{r[1]}@{r[2]:g}" for r in rows if r[2] is not None] for rows in trace(pushes, limits)]


@pytest.mark.parametrize(
    "pushes,limits,want",
    [
        ([(480, [[750, -1]])], None, [["start@750"]]),
        ([(480, [[750, -1]]), (480, [[-1, 4480]])], None, [["start@750"], ["end@4480"]]),
        ([(1000, [[100, 900]])], None, [["start@100", "end@900"]]),
        ([(1500, [[100, 900], [1200, -1]])], None, [["start@100", "end@900", "start@1200"]]),
        ([(480, [[750, -1]]), (480, [[900, -1]])], None, [["start@750"], []]),
        ([(480, [[-1, 4480]])], None, [[]]),
        ([(480, [[750, -1]]), (480, [[900, 1800]])], None, [["start@750"], ["end@1800"]]),
        ([(480, [[-1, -1], [1, 2, 3], [750, -1]])], None, [["start@750"]]),
        ([(500, [[0, -1]]), (500, [])], SHORT, [["start@0"], ["forced_end@1000"]]),
        ([(500, [[0, -1]]), (480, [])], SHORT, [["start@0"], []]),
        ([(500, []), (500, [[500, -1]]), (400, []), (200, [])], SHORT, [[], ["start@500"], [], ["forced_end@1600"]]),
        ([(500, [[0, -1]]), (500, []), (500, [[2000, -1]])], SHORT, [["start@0"], ["forced_end@1000"], ["start@2000"]]),
        ([(500, [[0, -1]]), (500, []), (500, [[-1, 1400]])], SHORT, [["start@0"], ["forced_end@1000"], []]),
        ([(480, [[750, -1]]), (0, [[-1, 4480]], True)], None, [["start@750"], ["end@4480"]]),
    ],
)
def test_gate(pushes, limits, want):
    assert events(pushes, limits) == want


def fed(pushes, look_back):
    return [(r[3], r[4]) for rows in trace(pushes, Limits(look_back_ms=look_back)) for r in rows if r[1] == "fed" and r[4] > r[3]]


def test_slices():
    ms = lambda x: x * 16
    assert fed([(1000, [[500, -1]])], 1000) == [(ms(500), ms(1000))]
    assert fed([(480, []), (480, []), (480, [[0, -1]])], 50)[0][0] == 3 * 7680 - 800 - 7680
    assert fed([(480, []), (480, [[500, -1]]), (480, [[-1, 1300]])], 100) == [(ms(500), ms(960)), (ms(960), ms(1300))]
    assert fed([(480, [[100, 400]]), (480, []), (480, [[1000, 1300]])], 1000) == [(ms(100), ms(400)), (ms(1000), ms(1300))]


def test_results_are_on_the_stream_clock():
    rows = [(r[1], r[8], r[9]) for x in trace([(480, []), (480, [[500, -1]]), (480, [[-1, 1300]])], Limits(chunk_size=2)) for r in x if r[1] in ("partial", "final")]
    assert rows == [("partial", 500.0, 960.0), ("final", 500.0, 1300.0)]


def test_endpoint_before_what_was_fed_flushes_without_sending_again():
    rows = trace([(480, [[0, -1]]), (480, [[-1, 200]])])
    assert [r[1] for r in rows[1]] == ["end", "fed", "final"] and rows[1][1][3:5] == (7680, 7680)


def test_silence_gives_nothing():
    assert trace([(480, []), (480, [], True)]) == [[], []]


WINDOWS = Limits(chunk_size=2, max_history=4)


@pytest.mark.parametrize(
    "frames,want",
    [
        ([1, 1], [[], [("partial", 0, 2)]]),
        ([4], [[("partial", 0, 4)]]),
        ([2, 2, 2, 2], [[("partial", 0, 2)], [("partial", 0, 4)], [("partial", 4, 6)], [("partial", 4, 8)]]),
        ([10], [[("partial", 6, 10)]]),
    ],
)
def test_history_windows(frames, want):
    pushes = [(f * 60, [[0, -1]] if k == 0 else []) for k, f in enumerate(frames)]
    assert [[(r[1], r[5], r[6]) for r in rows if r[1] == "partial"] for rows in trace(pushes, WINDOWS)] == want


def test_confirmed_prefix():
    names = iter("ABCD")
    state, texts = State(), []
    for seq in range(4):
        state, rows = step(state, seq, 1920, [[0, -1]] if not seq else [], False, None, WINDOWS, lambda a, b: next(names))
        texts += [r[7] for r in rows if r[1] == "partial"]
    assert texts == ["A", "B", "BC", "BD"]


def test_reset_and_eof():
    assert events([(480, [[100, -1]]), (0, [], False, "reset"), (480, [[-1, 300]])]) == [["start@100"], [], []]
    assert events([(480, [[100, -1]]), (0, [], False, "eof"), (480, [[900, -1]])]) == [["start@100"], ["end@480"], ["start@900"]]


def test_a_detectors_clock_restarts_after_a_flush():
    own = Limits(detector_clock=True)
    pushes = [(480, [[100, -1]]), (0, [[-1, 300]], False, "eof"), (480, [[200, -1]]), (480, [[-1, 700]], True), (480, [[50, 90]])]
    assert events(pushes, own) == [["start@100"], ["end@300"], ["start@680"], ["end@1180"], ["start@1490", "end@1530"]]
    assert [(r[3], r[4]) for r in trace(pushes, own)[4] if r[1] == "fed"] == [(1490 * 16, 1530 * 16)]
    # open edges stay open, and a reset starts the clock again
    assert events([(480, [], True), (480, [[-1, 20]]), (0, [], False, "reset"), (480, [[30, -1]])], own) == [[], [], [], ["start@30"]]
    assert events(pushes[:3]) == [["start@100"], ["end@300"], ["start@200"]]


def test_flushes_without_audio():
    fresh, holding = State(), State(held=16)
    assert [detector_samples(fresh, 0, f) for f in (False, True)] == [0, 0]
    assert [detector_samples(holding, 0, f) for f in (False, True)] == [0, 1] and detector_samples(holding, 480, True) == 480
    # nothing to ask about: no audio yet, no audio in the push, and a flush right after a flush
    assert events([(0, [[10, -1]], True)]) == [[]]
    assert events([(480, []), (0, [[10, -1]])]) == [[], []]
    assert events([(480, [[10, -1]]), (0, [[-1, 400]], True), (0, [[410, -1]], True), (480, [[500, -1]])]) == [["start@10"], ["end@400"], [], ["start@500"]]
    # the silent sample isn't the stream's
    state = State()
    for p in ((0, 7680, False), (1, 0, True)):
        state, _ = step(state, p[0], p[1], [], p[2], None, Limits())
    assert (state.samples, state.held, state.clock_ms) == (7680, 0, 480.0)


def test_text_with_and_without_tags():
    names = iter(["<|en|>one ", "<|en|><|HAPPY|>two ", "<|zh|>three", "<|en|>all"])
    state, got = State(), []
    for seq in range(4):
        state, rows = step(state, seq, 1920, [[0, -1]] if not seq else [], seq == 3, None, WINDOWS, lambda a, b: next(names))
        got += [(r[7], r[10]) for r in rows if r[1] in ("partial", "final")]
    assert got == [
        ("one ", "<|en|>one "),
        ("two ", "<|en|><|HAPPY|>two "),
        ("two three", "<|en|><|HAPPY|>two <|zh|>three"),
        ("all", "<|en|>all"),
    ]


def test_a_failing_decoder_falls_back():
    def broken(first, end):
        raise RuntimeError("too long")

    _, rows = step(State(), 0, 1920, [[0, 100]], False, None, WINDOWS, with_fallback(broken, frames_text))
    assert [r[7] for r in rows if r[1] == "final"] == ["[0,1)"]


def test_limits_are_checked():
    with pytest.raises(ValueError):
        Limits(chunk_size=0)
    with pytest.raises(ValueError):
        Limits(chunk_size=12, max_history=4)


PUSHES = [
    {"stream_id": s, "seq": k, "samples": 7680, "intervals": [[k * 480.0 - 100, -1.0]] if k % 7 == 1 else [[-1.0, k * 480.0 + 50]] if k % 7 == 5 else [], "is_final": k == 29, "control": None}
    for s in ("a", "b", "c")
    for k in range(30)
]


@pytest.mark.parametrize("files", [1, 4, 15])
def test_stream_equals_batch(spark, tmp_path, files):
    for k in range(files):
        part = [p for p in PUSHES if p["seq"] * files // 30 == k]
        (tmp_path / f"in{k:02d}.json").write_text("\n".join(json.dumps(p) for p in reversed(part)))
    schema = "stream_id string, seq long, samples long, intervals array<array<double>>, is_final boolean, control string"
    batch = jobs.fold_sessions(spark.read.schema(schema).json(str(tmp_path))).collect()
    name = f"sessions{files}"
    # the file source takes files by modification time
    ordered = tmp_path / "ordered"
    ordered.mkdir()
    query = jobs.stream_sessions(manifests.read_pushes(spark, str(ordered))).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for k in range(files):
            shutil.copy(tmp_path / f"in{k:02d}.json", ordered / f"in{k:02d}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, batch)) and batch
