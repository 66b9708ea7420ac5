"""Segments of event streams in batch form: what needs no carried state is joins and windows.

Intervals are (start_ms, end_ms) with -1 for an edge that isn't known; times are milliseconds from the stream's start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

OPEN = -1.0


def well_formed(intervals: Column) -> Column:
    """Pairs of which one edge at least is known."""
    return F.filter(intervals, lambda iv: (F.size(iv) == 2) & ~((F.get(iv, 0) == OPEN) & (F.get(iv, 1) == OPEN)))


def interval_events(intervals: Column) -> Column:
    """Each pair as a start, an end or both, in order."""
    pair = lambda iv: F.array(F.struct(F.lit("start").alias("kind"), F.get(iv, 0).alias("time_ms")), F.struct(F.lit("end").alias("kind"), F.get(iv, 1).alias("time_ms")))
    return F.filter(F.flatten(F.transform(well_formed(intervals), pair)), lambda e: e["time_ms"] != OPEN)


def alternate(events: DataFrame, key: str, order: str, kind: str = "kind") -> DataFrame:
    """Starts while open and ends while closed are dropped: of each run of a kind its first event stays, no leading end."""
    found = ordered.previous(events, key, order, kind, "_before")
    return found.where((F.col(kind) != F.col("_before.value")) | (F.col("_before").isNull() & (F.col(kind) == "start"))).drop("_before")


def pair_segments(events: DataFrame, key: str, order: str, time: str, end_of: DataFrame | None = None) -> DataFrame:
    """Alternating events as segments; one that is still open ends at ``end_of``'s stream_ms, if that is given."""
    back = ordered.previous(events.withColumn("_back", -F.col(order)), key, "_back", time, "_after")
    paired = back.where(F.col("kind") == "start").withColumn("end_ms", F.col("_after.value")).withColumnRenamed(time, "start_ms")
    if end_of is not None:
        paired = paired.join(end_of, key, "left").withColumn("end_ms", F.coalesce("end_ms", "stream_ms")).drop("stream_ms")
    return paired.select(key, "start_ms", "end_ms")


def keep_apart(segments: DataFrame, key: str, ties: Sequence[str], total: str, start: str = "start", end: str = "end") -> DataFrame:
    """Starts moved past all earlier ends, ends cut to the stream, empty segments dropped. The order is by start, then ``ties``."""
    found = ordered.running_max(segments, key, start, end, "_before", ties)
    moved = found.withColumn(start, F.greatest(F.lit(0), F.col(start), F.col("_before"))).withColumn(end, F.least(F.col(end), F.col(total))).drop("_before")
    return moved.where(F.col(end) > F.col(start))


def carry_forward(frames: DataFrame, key: str, order: str, setting: str, default: str, name: str) -> DataFrame:
    """The last setting given before or at a frame."""
    return ordered.latest(frames, key, order, setting, "_given").withColumn(name, F.coalesce("_given", F.lit(default))).drop("_given")


def rebase(ms: Column, segment_start: Column, rate: int = 16_000) -> Column:
    """Segment-relative time as stream time."""
    return segment_start * 1000.0 / rate + ms


def slice_chunks(chunks: DataFrame, segments: DataFrame, key: str, width: int) -> DataFrame:
    """The part of each chunk [lo, hi) inside each segment [start, end).

    A range join as an equality join: both sides are cut into bins of ``width`` samples, and a pair is kept in its
    first common bin only. Without the bins every chunk of a key would meet every segment of it.
    """
    binned = lambda df, a, b: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    left = binned(chunks.where("hi > lo"), "lo", "hi")
    right = binned(segments.where("`end` > `start`"), "start", "end")
    both = left.join(right, [key, "_bin"]).where((F.col("lo") < F.col("end")) & (F.col("hi") > F.col("start")))
    first = both.where(F.col("_bin") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("start") / width)))
    return first.withColumn("from", F.greatest("lo", "start")).withColumn("to", F.least("hi", "end")).drop("_bin")


def at_least(segments: DataFrame, samples: int = 400, start: str = "start", end: str = "end") -> DataFrame:
    """Without segments shorter than one analysis window."""
    return segments.where(F.col(end) - F.col(start) >= samples)


def is_speech(silence: Column) -> Column:
    """The frame predicate: speech outweighs silence by half at least."""
    return (1.0 - silence) >= (silence + 0.5)
