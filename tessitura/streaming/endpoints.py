"""Offline endpoint detection over silence probabilities, and frame stacking with carried context."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessitura.operators.ordered import fold_groups

# Frames are 10 ms; window, thresholds and margins in frames; the end-silence schedule in ms.
FRAME_MS, SMOOTHED, TO_SPEECH, TO_SILENCE, LOOK_BACK, END_MARGIN, CHUNK = 10, 20, 15, 15, 40, 11, 6000
SCHEDULE = ((10_000, 2000), (20_000, 1000), (30_000, 800), (40_000, 600), (50_000, 400), (60_000, 200), (float("inf"), 100))


def end_silence(spoken_ms: int) -> int:
    """Frames of silence that end a segment, given how long speech has lasted at chunk borders."""
    return max(0, next(wait for limit, wait in SCHEDULE if spoken_ms <= limit) - 150) // FRAME_MS


class Endpoints:
    """The detector's state between frames: any split of a recording gives the segments of the whole."""

    def __init__(self, longest_ms: int = 60_000):
        self.longest = longest_ms // FRAME_MS
        self.recent: deque[int] = deque([0] * SMOOTHED, SMOOTHED)
        self.talking, self.begin, self.quiet, self.spoken, self.latched, self.last_end = False, None, 0, 0, False, 0
        self.wait, self.frames = end_silence(0), 0

    def _settle(self, begin: int, end: int) -> list[tuple[int, int]]:
        begin, found = max(begin, self.last_end, 0), []
        if end > begin:
            found = [(begin * FRAME_MS, end * FRAME_MS)]
            self.last_end = end
        self.recent.extend([0] * SMOOTHED)
        self.talking, self.begin, self.quiet, self.spoken, self.latched = False, None, 0, 0, False
        return found

    def push(self, silence: np.ndarray) -> list[tuple[int, int]]:
        """Segments in ms that end within these frames."""
        speech = (np.float32(1) - silence >= silence + np.float32(0.5)).astype(int)
        out: list[tuple[int, int]] = []
        for t, loud_frame in enumerate(speech.tolist(), self.frames):
            if t and t % CHUNK == 0:
                if self.begin is not None or self.latched:
                    self.spoken, self.latched = self.spoken + CHUNK * FRAME_MS, True
                self.wait = end_silence(self.spoken)
            self.recent.append(loud_frame)
            loud, was = sum(self.recent), self.talking
            self.talking = loud >= TO_SPEECH if not was else loud > TO_SILENCE
            if not was and self.talking and self.begin is None:
                self.quiet, self.begin = 0, max(t - LOOK_BACK, self.last_end, 0)
                continue
            self.quiet = 0 if was or self.talking else self.quiet + 1
            if self.begin is None:
                continue
            if self.quiet and self.quiet >= self.wait:
                out += self._settle(self.begin, t - max(0, self.wait - END_MARGIN))
            elif t - self.begin + 1 > self.longest:
                out += self._settle(self.begin, t)
        self.frames += len(speech)
        return out

    def finish(self) -> list[tuple[int, int]]:
        return self._settle(self.begin, self.frames) if self.begin is not None else []


def segments(silence: np.ndarray, longest_ms: int = 60_000) -> list[tuple[int, int]]:
    """Speech segments of a whole recording, in ms."""
    detector = Endpoints(longest_ms)
    return detector.push(silence) + detector.finish()


def detect_segments(frames: DataFrame, key: str, order: str, silence: str, longest_ms: int = 60_000) -> DataFrame:
    """key, start_ms, end_ms; each recording is read in order, batch by batch, as each frame depends on the ones before it."""
    schema = f"`{key}` {dict(frames.dtypes)[key]}, start_ms long, end_ms long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fold(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Endpoints(longest_ms)

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            starts, ends = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([value] * len(found), arrow.types[0]), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=arrow)

        for batch in batches:
            yield rows(detector.push(batch.column("s").to_numpy(zero_copy_only=False).astype(np.float32)))
        yield rows(detector.finish())

    some = frames.select(key, F.col(order).alias("o"), F.col(silence).cast("float").alias("s"))
    return fold_groups(some, key, ["o"], fold, schema)


def stack_online(carried: list, rows: list, m: int, n: int, first: bool, final: bool) -> tuple[list, list]:
    """Stack every n-th frame with its neighbours, as far as they are known: (stacked rows, rows to carry).

    The first call repeats the first frame in front; the last one repeats the last frame where neighbours are missing.
    """
    if n > m:
        raise ValueError("frames between stacks would be lost")
    held = ([rows[0]] * ((m - 1) // 2) if first and rows else []) + carried + rows
    out, at, centre = [], 0, (m - 1) // 2
    while at + (centre if final else m - 1) < len(held):
        near = held[at : at + m]
        out.append([x for row in near + [held[-1]] * (m - len(near)) for x in row])
        at += n
    return out, held[at:] if not final else []
