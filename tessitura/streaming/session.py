"""Carried state of one audio stream: endpoint gate, look-back window, recogniser windows.

A push is a row (seq, samples, intervals, is_final, control): how many samples came, what the endpoint detector said
((start_ms, end_ms) pairs, -1 for an unknown edge), and the stream's controls (``eof`` flushes, ``reset`` drops all
state without output). The fold gives events and results as rows; audio appears as sample ranges, and a decoder is a
function of a range of frames, so no model is needed. The state is one small record per stream, whatever its length.

A detector isn't asked about a push without samples, but for a flush while it holds audio; that flush is one silent
sample for the detector alone (``detector_samples``). What such a push says otherwise is left out. A detector's clock
begins anew after each flush; ``Limits.detector_clock`` says that the pushes' times are on it, and they are then moved to
the stream's clock. Results have their text without tags, and as it was decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from tessitura.functions.text import TAG

OPEN = -1.0
#: Samples that a detector gets for a flush without audio.
FLUSH_PAD = 1
OUTPUT = "seq long, kind string, time_ms double, from_sample long, to_sample long, window_from long, window_to long, text string, start_ms double, end_ms double, raw_text string"
COLUMNS = ["seq", "kind", "time_ms", "from_sample", "to_sample", "window_from", "window_to", "text", "start_ms", "end_ms", "raw_text"]


@dataclass(frozen=True)
class Limits:
    """Rate, frame size (samples), and the policy's limits; frames count from a segment's first sample."""

    rate: int = 16_000
    frame: int = 960
    chunk_size: int = 12
    max_history: int = 167
    segment_ms: float = 30_000.0
    look_back_ms: float = 1_000.0
    detector_clock: bool = False  # intervals count from the detector's last flush, not from the stream's start

    def __post_init__(self):
        if min(self.rate, self.frame, self.chunk_size, self.max_history) <= 0 or self.segment_ms <= 0 or self.look_back_ms < 0:
            raise ValueError("limits must be positive")
        if self.max_history < self.chunk_size:
            raise ValueError("the history must hold a chunk")


@dataclass
class State:
    samples: int = 0  # of the stream so far
    speaking: bool = False
    opened_ms: float = 0.0
    kept_from: int = 0  # oldest sample that the look-back window still has
    fed: int = 0  # first sample that the recogniser hasn't had
    segment: int = 0  # first sample of the segment
    heard: int = 0  # samples of the segment
    frames: int = 0
    pending: int = 0  # frames since the last partial
    window: int = 0  # first frame of the window
    decoded: int = 0  # frames of the window that the last partial covered
    confirmed: str = ""  # settled text without its tags
    confirmed_raw: str = ""
    last: str = ""  # of the window, as decoded
    held: int = 0  # samples that the detector has had since its last flush
    clock_ms: float = 0.0  # the stream's time at that flush


def without_tags(text: str) -> str:
    return re.sub(TAG, "", text)


def detector_samples(s: State, samples: int, is_final: bool) -> int:
    """How many samples a detector gets for a push; 0: it isn't asked. A second flush in a row isn't passed on."""
    return samples or (FLUSH_PAD if is_final and s.held else 0)


def frames_text(first: int, end: int) -> str:
    """The stand-in decoder: names its frames."""
    return f"[{first},{end})"


def with_fallback(decode: Callable[[int, int], str], other: Callable[[int, int], str]) -> Callable[[int, int], str]:
    """A decoder that answers with ``other`` where ``decode`` fails, so that a segment still gets its result."""

    def run(first: int, end: int) -> str:
        try:
            return decode(first, end)
        except (RuntimeError, ValueError, ArithmeticError):
            return other(first, end)

    return run


def _feed(s: State, upto: int, last: bool, limits: Limits, decode: Callable[[int, int], str], seq: int, out: list) -> None:
    upto = max(upto, s.fed)
    first, s.fed = s.fed, upto
    if upto == first and not last:
        return
    s.heard += upto - first
    new = s.heard // limits.frame - s.frames
    s.frames += new
    s.pending += new
    offset = s.segment * 1000.0 / limits.rate
    end_ms = offset + s.heard * 1000.0 / limits.rate
    out.append((seq, "fed", None, first, upto, None, None, None, None, None, None))
    if last:
        if s.frames:
            raw = decode(0, s.frames)
            out.append((seq, "final", None, None, None, 0, s.frames, without_tags(raw), offset, end_ms, raw))
    elif s.pending >= limits.chunk_size:
        s.pending = 0
        if s.frames - s.window > limits.max_history:
            if s.decoded:  # what was decoded is settled; the next window begins behind it
                s.confirmed += without_tags(s.last)
                s.confirmed_raw += s.last
                s.window += s.decoded
            s.last = ""
            s.window = max(s.window, s.frames - limits.max_history)
        s.last = decode(s.window, s.frames)
        s.decoded = s.frames - s.window
        out.append((seq, "partial", None, None, None, s.window, s.frames, s.confirmed + without_tags(s.last), offset, end_ms, s.confirmed_raw + s.last))


def step(s: State, seq: int, samples: int, intervals, is_final: bool, control: str | None, limits: Limits, decode: Callable[[int, int], str] = frames_text) -> tuple[State, list[tuple]]:
    """One push: the new state and the rows that it gives, in order.

    ``decode(first, end)`` says the text of a segment's frames; one with ``open_segment`` is told the first sample of each
    segment that opens.
    """
    if control == "reset":
        return State(), []
    is_final = bool(is_final) or control == "eof"
    out: list[tuple] = []
    s.samples += int(samples or 0)
    now_ms = s.samples * 1000.0 / limits.rate
    events: list[tuple[str, float]] = []
    speaking, opened = s.speaking, s.opened_ms

    def take(kind: str, at: float) -> None:
        nonlocal speaking, opened
        if (kind == "start") != speaking:  # starts while speaking and ends while silent say nothing new
            speaking = kind == "start"
            opened = at if speaking else opened
            events.append((kind, at))

    asked = detector_samples(s, int(samples or 0), is_final)
    began = s.clock_ms if limits.detector_clock else 0.0
    for pair in intervals if asked and intervals is not None else ():
        if len(pair) != 2 or (pair[0] == OPEN and pair[1] == OPEN):
            continue
        for kind, at in zip(("start", "end"), pair, strict=True):
            if at != OPEN:
                take(kind, began + float(at))
    s.held = 0 if is_final else s.held + asked
    if is_final:
        s.clock_ms = now_ms
    if speaking and now_ms - opened >= limits.segment_ms:
        take("forced_end", now_ms)
    if is_final and speaking:
        take("end", now_ms)
    for kind, at in events:
        out.append((seq, kind, at, None, None, None, None, None, None, None, None))
        index = max(0, min(round(at * limits.rate / 1000.0), s.samples))
        if kind == "start":
            begin = max(index, s.kept_from)
            if hasattr(decode, "open_segment"):
                decode.open_segment(begin)
            s = State(samples=s.samples, speaking=True, opened_ms=at, kept_from=s.kept_from, fed=begin, segment=begin, held=s.held, clock_ms=s.clock_ms)
        else:
            _feed(s, index, True, limits, decode, seq, out)
            s.speaking = False
    if s.speaking:
        _feed(s, s.samples, False, limits, decode, seq, out)
    keep = s.samples - int(limits.look_back_ms * limits.rate / 1000)
    s.kept_from = max(s.kept_from, min(keep, s.fed) if s.speaking else keep)
    return s, out


def to_json(s: State) -> str:
    return json.dumps(asdict(s))


def from_json(text: str) -> State:
    return State(**json.loads(text))
