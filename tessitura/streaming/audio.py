"""Streams of frames with their audio: formats, controls, endpoint gate and recogniser over samples kept in state.

A frame is a row (seq, kind, payload, intervals). ``open`` frames hold the address that a client asked for, whose
``format`` parameter is the first format; ``text`` frames are commands (``eof`` flushes, ``reset`` drops all without
output, ``config`` changes the format of the frames behind it); ``binary`` frames are PCM in the format in force there.
Broken frames give a row of kind ``error`` and are skipped, the stream goes on.

The samples that may still be needed are a ring of chunks: those of the look-back window, and, where ``hear`` decodes
audio, those of the open segment (which the policy's cap bounds). Rows of kind ``fed`` carry exactly the samples of
their range. In a streaming query the ring is a map state by first sample, so that a micro-batch writes only chunks
that came or went, short pushes of a micro-batch as one; timers close streams that were left without ``eof``.

What an endpoint detector says comes with the frames (``intervals``), or from ``detect(samples, is_final, memory)``, whose
``memory`` is a dict of JSON values that is kept with the stream; such a detector's clock is its own
(``Limits.detector_clock``).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Collection, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessitura.functions.audio import WIDTHS, command_and_fields, pcm_samples
from tessitura.operators.ordered import fold_groups

from .session import COLUMNS, FLUSH_PAD, OUTPUT, Limits, State, detector_samples, frames_text, step

FRAMES = "stream_id string, seq long, kind string, payload binary, intervals array<array<double>>"
RESULTS = f"{OUTPUT}, audio array<float>"
DEFAULT_FORMAT = "float32"
#: Samples of a chunk of state that short pushes are joined to at most.
CHUNK = 16_384


class Ring:
    """Chunks of a stream's latest samples, by the number of their first sample."""

    def __init__(self, chunks: dict[int, bytes] | None = None):
        self.chunks = deque((first, np.frombuffer(raw, "<f4")) for first, raw in sorted((chunks or {}).items()))

    def append(self, first: int, samples: np.ndarray) -> None:
        if len(samples):
            self.chunks.append((first, samples))

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The samples [begin, end), across chunk edges."""
        parts = [x[max(0, begin - first) : max(0, end - first)] for first, x in self.chunks if first < end and first + len(x) > begin]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def evict(self, before: int) -> None:
        """Drop the samples before that one."""
        while self.chunks and self.chunks[0][0] + len(self.chunks[0][1]) <= before:
            self.chunks.popleft()
        if self.chunks and self.chunks[0][0] < before:
            first, x = self.chunks.popleft()
            self.chunks.appendleft((before, x[before - first :]))

    def __len__(self) -> int:
        return sum(len(x) for _, x in self.chunks)

    def stored(self, known: Collection[int] = ()) -> dict[int, bytes]:
        """The chunks as bytes; those that don't begin at a ``known`` place and follow each other are joined, up to ``CHUNK`` samples."""
        joined: dict[int, list[np.ndarray]] = {}
        last, size = -1, 0
        for first, x in self.chunks:
            if last in joined and last not in known and first not in known and last + size == first and size + len(x) <= CHUNK:
                joined[last].append(x)
                size += len(x)
            else:
                joined[first], last, size = [x], first, len(x)
        return {first: np.concatenate(parts).astype("<f4", copy=False).tobytes() for first, parts in joined.items()}


class _Hearing:
    """``hear``, a function of samples, as a decoder of a segment's frames."""

    def __init__(self, hear: Callable[[np.ndarray], str], ring: Ring, frame: int, segment: int):
        self.hear, self.ring, self.frame, self.segment = hear, ring, frame, segment

    def open_segment(self, first: int) -> None:
        self.segment = first

    def __call__(self, first: int, end: int) -> str:
        return self.hear(self.ring.slice(self.segment + first * self.frame, self.segment + end * self.frame))


@dataclass(frozen=True)
class Model:
    """What a stream is worked on with: the policy's limits, a decoder and a detector of samples, both optional."""

    limits: Limits = Limits()
    hear: Callable[[np.ndarray], str] | None = None
    detect: Callable[[np.ndarray, bool, dict], list] | None = None


class AudioStream:
    """One stream from frame to frame. Without ``hear``, results name their frames."""

    def __init__(self, model: Model | None = None, stored: str | None = None, chunks: dict[int, bytes] | None = None):
        self.model = model or Model()
        known = json.loads(stored) if stored else {}
        self.limits, self.state, self.form, self.seq = self.model.limits, State(**known.get("state", {})), known.get("form", DEFAULT_FORMAT), known.get("seq", -1)
        self.memory: dict = known.get("memory", {})
        self.ring = Ring(chunks)
        hear = self.model.hear
        self.decode = _Hearing(hear, self.ring, self.limits.frame, self.state.segment) if hear else frames_text

    def frame(self, seq: int, kind: str | None, payload: bytes | None, intervals=None) -> list[tuple]:
        self.seq = int(seq)
        if kind == "open":
            asked = [f.lower() for f in parse_qs(urlsplit((payload or b"").decode("utf-8", "replace")).query).get("format", [])]
            self.form = asked[0] if asked and asked[0] in WIDTHS else DEFAULT_FORMAT
            return [self._said("ready", self.form)]
        if kind == "text":
            return self._command((payload or b"").decode("utf-8", "replace"))
        samples = pcm_samples(payload, self.form) if kind == "binary" else None
        if samples is None:
            size = len(payload) if payload is not None else 0
            return [self._said("error", f"{size} bytes hold no whole {self.form} samples" if kind == "binary" and payload is not None else "no audio")]
        return self._push(samples, intervals, False)

    def _command(self, message: str) -> list[tuple]:
        command, fields = command_and_fields(message)
        if command == "eof":
            return [*self._push(np.zeros(0, np.float32), None, True), self._said("eof", None)]
        if command == "reset":
            self.state, self.memory = State(), {}
            self.ring.evict(1 << 62)
            return [self._said("reset", None)]
        if command == "config":
            asked = str(fields.get("format", self.form))
            if asked not in WIDTHS:
                return [self._said("error", f"no such format: {asked}")]
            self.form = asked
            return [self._said("config", asked)]
        return [self._said("error", f"not a command: {command}")]

    def _said(self, kind: str, text: str | None) -> tuple:
        return (self.seq, kind, None, None, None, None, None, text, None, None, None, None)

    def _push(self, samples: np.ndarray, intervals, is_final: bool) -> list[tuple]:
        if self.model.detect:
            asked = detector_samples(self.state, len(samples), is_final)
            intervals = self.model.detect(samples if len(samples) else np.zeros(FLUSH_PAD, np.float32), is_final, self.memory) if asked else None
            self.memory = {} if is_final else self.memory
        self.ring.append(self.state.samples, samples)
        self.state, rows = step(self.state, self.seq, len(samples), intervals, is_final, None, self.limits, self.decode)
        out = [(*row, self.ring.slice(row[3], row[4]) if row[1] == "fed" else None) for row in rows]
        keep = self.state.kept_from
        if self.state.speaking and self.decode is not frames_text:
            keep = min(keep, self.state.segment)
        self.ring.evict(keep)
        return out

    def close(self) -> list[tuple]:
        """Flush as ``eof`` does, for a stream that was left."""
        return self._push(np.zeros(0, np.float32), None, True)

    def stored(self) -> str:
        return json.dumps({"state": asdict(self.state), "form": self.form, "seq": self.seq, "memory": self.memory})


def _table(key: str, value: object, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(value, *row) for row in rows], columns=[key, *COLUMNS, "audio"])


def _with_intervals(frames: DataFrame) -> DataFrame:
    return frames if "intervals" in frames.columns else frames.withColumn("intervals", F.lit(None).cast("array<array<double>>"))


def fold_audio(frames: DataFrame, key: str = "stream_id", model: Model | None = None) -> DataFrame:
    """Rows of every complete stream; each is read in order of ``seq``, a few frames at a time."""
    schema = f"`{key}` {dict(frames.dtypes)[key]}, {RESULTS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fold(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = AudioStream(model)
        for batch in batches:
            rows = [r for f in batch.to_pylist() for r in stream.frame(f["seq"], f["kind"], f["payload"], f["intervals"])]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (value, *r), strict=True)) for r in rows], arrow)

    return fold_groups(_with_intervals(frames).select(key, "seq", "kind", "payload", "intervals"), key, ["seq"], fold, schema)


class AudioProcessor(StatefulProcessor):
    """Keeps each stream's record and its ring; rows of a micro-batch are taken by ``seq``."""

    def __init__(self, key: str, model: Model | None, idle_ms: int | None, event_time: str | None):
        self.key, self.model, self.idle_ms, self.event_time = key, model, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("record", "value string")
        self.chunks = handle.getMapState("chunks", "first long", "pcm binary")

    def _load(self) -> tuple[AudioStream, dict[int, bytes]]:
        if not self.kept.exists():
            return AudioStream(self.model), {}
        chunks = {k[0]: bytes(v[0]) for k, v in self.chunks.iterator()}
        return AudioStream(self.model, self.kept.get()[0], chunks), chunks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stream, before = self._load()
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [r for f in zip(*(frames[c] for c in ("seq", "kind", "payload", "intervals")), strict=True) for r in stream.frame(*f)]
        after = stream.ring.stored(before)
        for first in before.keys() - after.keys():
            self.chunks.removeKey((first,))
        for first, pcm in after.items():
            if before.get(first) != pcm:  # after a reset numbers begin again
                self.chunks.updateValue((first,), (pcm,))
        self.kept.update((stream.stored(),))
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            now = int(frames[self.event_time].max().timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle_ms)
        yield _table(self.key, key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for the idle time: the open segment ends, the stream is forgotten."""
        stream, _ = self._load()
        out = stream.close()
        self.kept.clear()
        self.chunks.clear()
        yield _table(self.key, key[0], out)

    def close(self) -> None:
        pass


def stream_audio(
    frames: DataFrame,
    key: str = "stream_id",
    model: Model | None = None,
    idle_ms: int | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """The rows of ``fold_audio`` from a streaming DataFrame; needs the RocksDB state store.

    With ``idle_ms`` a stream without frames for so long gets its last ``end`` and ``final`` and loses its state; frames that come
    later begin a new stream. The clock is the machine's, or, with ``event_time`` (a column with a watermark), the data's.
    """
    return _with_intervals(frames).groupBy(key).transformWithStateInPandas(
        statefulProcessor=AudioProcessor(key, model, idle_ms, event_time),
        outputStructType=f"`{key}` {dict(frames.dtypes)[key]}, {RESULTS}",
        outputMode="Append",
        timeMode="None" if idle_ms is None else "EventTime" if event_time else "ProcessingTime",
    )
