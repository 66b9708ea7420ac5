"""Kernels over arrays: tokens, frames, waveforms. Column expressions only; NaN counts as the largest value of an array."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
MS_PER_FRAME = 60


def let(value: Column, body) -> Column:
    """``body(value)``, the value being computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse_repeats(a: Column) -> Column:
    """Without consecutive duplicates."""
    return let(a, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def ctc_greedy(ids: Column, blank: int = 0) -> Column:
    """Best-path decoding of frame ids: repeats collapse, then blanks go, so a blank parts equal tokens."""
    return let(ids, lambda a: F.filter(a, lambda x, i: ((i == 0) | (x != F.get(a, i - 1))) & (x != blank)))


def argmax(a: Column) -> Column:
    """Position (from 0) of the first largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ban(a: Column, index: int) -> Column:
    """One value out of reach of argmax."""
    return F.transform(a, lambda x, i: F.when(i == index, F.lit(float("-inf"))).otherwise(x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def softmax(a: Column) -> Column:
    shifted = let(F.array_max(a), lambda most: F.transform(a, lambda x: F.exp(x - most)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(a: Column) -> Column:
    shift = lambda most: most + F.log(total(F.transform(a, lambda x: F.exp(x - most))))
    return let(let(F.array_max(a), shift), lambda s: F.transform(a, lambda x: x - s))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Zero mean, unit deviation; an empty array stays empty."""
    centred = let(total(a) / F.greatest(F.size(a), F.lit(1)), lambda mean: F.transform(a, lambda x: x - mean))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.greatest(F.size(c), F.lit(1)) + eps), lambda sd: F.transform(c, lambda x: x / sd)))


def cmvn(a: Column, shift: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(a, shift, lambda x, s: x + s), scale, lambda x, s: x * s)


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(by))


def from_int16(a: Column) -> Column:
    """PCM16 samples in [-1, 1)."""
    return F.transform(a, lambda x: (x.cast("double") / 32768.0).cast("float"))


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def preemphasis(a: Column, factor: float = 0.97) -> Column:
    """x[i] - factor * x[i-1] after the mean is taken off; the first sample leans on itself. An empty array stays empty."""
    centred = let(total(F.transform(a, lambda x: x.cast("double"))) / F.greatest(F.size(a), F.lit(1)), lambda mean: F.transform(a, lambda x: x - mean))
    return let(centred, lambda c: F.transform(c, lambda x, i: x - factor * F.get(c, F.greatest(i - 1, F.lit(0)))))


def frame_count(samples: Column, window: int = 400, shift: int = 160) -> Column:
    return F.when(samples < window, F.lit(0)).otherwise(F.floor((samples - window) / shift) + 1).cast("int")


def framing(a: Column, window: int = 400, shift: int = 160) -> Column:
    """Overlapping windows of a waveform."""

    def cut(a: Column) -> Column:
        many = frame_count(F.size(a), window, shift)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: i < many)
        return F.transform(starts, lambda i: F.slice(a, i * shift + 1, window))

    return let(a, cut)


def stack_frames(frames: Column, m: int = 7, n: int = 6) -> Column:
    """Low frame rate: every ``n``-th frame with its ``m`` neighbours on end, the ends repeated."""

    def stack(frames: Column) -> Column:
        size = F.size(frames)
        many = F.ceil(size / n).cast("int")
        rows = F.filter(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: i < many)
        near = F.sequence(F.lit(0), F.lit(m - 1))
        at = lambda i, j: F.greatest(F.lit(0), F.least(i * n + j - (m - 1) // 2, size - 1))
        return F.transform(rows, lambda i: F.flatten(F.transform(near, lambda j: F.get(frames, at(i, j)))))

    return let(frames, stack)


def position_encoding(position: Column, depth: int) -> Column:
    """Sines, then cosines, of a position counted from 1. With a depth of 2 there is one rate, 1."""
    step = math.log(10_000) / max(depth / 2 - 1, 1)
    rates = F.array(*[F.lit(math.exp(-i * step)) for i in range(depth // 2)])
    return F.concat(F.transform(rates, lambda r: F.sin(position * r)), F.transform(rates, lambda r: F.cos(position * r)))


def chunks(a: Column, limit: int) -> Column:
    """Parts of ``limit`` items; an empty array is one empty part."""
    last = lambda a: F.greatest(F.ceil(F.size(a) / limit).cast("int"), F.lit(1)) - 1
    return let(a, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda i: F.slice(a, i * limit + 1, limit)))


def newest(a: Column, n: int) -> Column:
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def pad(a: Column, size: Column, value: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0))))


def sample_index(ms: Column, total_samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """A time as a sample's number, rounded half to even, inside the stream."""
    return F.greatest(F.lit(0), F.least(F.bround(ms * rate / 1000.0).cast("long"), total_samples))


def sample_index_truncated(ms: Column, rate: int = SAMPLE_RATE) -> Column:
    """The other rounding: towards zero."""
    return (ms * rate / 1000).cast("double").cast("long")


def frame_start_s(frame: Column) -> Column:
    return F.greatest((frame * MS_PER_FRAME - 30) / 1000.0, F.lit(0.0))


def frame_end_s(frame: Column, frames: Column) -> Column:
    return F.least((frame * MS_PER_FRAME - 30) / 1000.0, (frames * MS_PER_FRAME - 30) / 1000.0)


def mel(hz: Column) -> Column:
    return 1127.0 * F.log(1.0 + hz / 700.0)


def elapsed_ms(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return samples * 1000.0 / rate
