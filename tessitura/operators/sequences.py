"""Ordered rows per key: runs, sliding and weighted windows, numbering. Frames are rows, never padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import text as texts
from tessitura.functions.arrays import frame_end_s, frame_start_s
from tessitura.functions.text import is_english

from . import ordered

LEAST_DEVIATION = 1e-8

#: Repeated keys that are sent to all tasks at most; beyond that Spark joins by shuffle.
MOST_SENT = 500_000


def _with_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with the number of the run of equal values that each is in, from 1."""
    before = ordered.previous(rows, key, order, value, "_before")
    turned = before.withColumn("_new", (F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.value"))).cast("long"))
    return ordered.running_sum(turned, key, order, "_new", "run").drop("_before", "_new")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: a row per run of equal values, with its first and last order."""
    found = _with_runs(rows, key, order, value)
    return found.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min(value).alias("value"), F.count(F.lit(1)).alias("length"))


def run_timestamps(rows: DataFrame, key: str, order: str, value: str, blank: int = 0) -> DataFrame:
    """Seconds of every run that isn't blank; each key's frames are counted for itself. ``order`` counts from 0."""
    found = runs(rows, key, order, value)
    sized = found.join(found.groupBy(key).agg(F.sum("length").alias("frames")), key)
    return sized.where(F.col("value") != blank).select(
        key, "run", "value", F.round(frame_start_s(F.col("first")), 3).alias("start_s"), F.round(frame_end_s(F.col("last") + 1, F.col("frames")), 3).alias("end_s")
    )


def memory_filter(rows: DataFrame, key: str, frame: str, value: str, taps: list[float], before: int, name: str) -> DataFrame:
    """A frame plus the weighted sum of its neighbours: tap k weighs the row ``before - k`` places earlier; 0 outside.

    Frames are numbered without gaps, as by ``numbered``.
    """

    def weighted(own: Window) -> Column:
        out = F.col(value)
        for k, weight in enumerate(taps):
            shift = before - k
            near = F.col(value) if not shift else F.coalesce((F.lag(value, shift) if shift > 0 else F.lead(value, -shift)).over(own), F.lit(0.0))
            out = out + near * weight
        return out

    return ordered.over_neighbours(rows, key, frame, max(before, 0), max(len(taps) - 1 - before, 0), name, weighted)


def sliding_sum(rows: DataFrame, key: str, frame: str, value: str, many: int, name: str) -> DataFrame:
    """The sum of ``value`` over a frame and the ``many - 1`` before it; frames are numbered without gaps."""
    return ordered.over_neighbours(rows, key, frame, many - 1, 0, name, lambda own: F.sum(value).over(own.rowsBetween(-(many - 1), 0)))


def stack_rows(rows: DataFrame, key: str, frame: str, vec: str, m: int, n: int, total: str | None = None) -> DataFrame:
    """Stacks of ``m`` frames, one every ``n``, as rows (key, frame, stacked); frames outside a key are its first or last one.

    The result of ``arrays.stack_frames`` without a key's frames in one row: each frame goes to the few stacks that
    hold it. Frames are numbered from 0 without gaps; ``total`` names a column with a key's number of frames, which ``numbered``
    can give with the numbers.
    """
    left = (m - 1) // 2
    sized = rows.withColumn("_all", F.col(total)) if total else rows.join(rows.groupBy(key).agg((F.max(frame) + 1).alias("_all")), key)
    at = F.col(frame)
    lowest = F.greatest(F.lit(0), F.when(at > 0, F.floor((at + left - m + 1) / F.lit(n))).otherwise(0))
    highest = F.when(at == F.col("_all") - 1, F.ceil(F.col("_all") / F.lit(n)) - 1).otherwise(F.least(F.floor((at + left) / F.lit(n)), F.ceil(F.col("_all") / F.lit(n)) - 1))
    stacks = sized.where(highest >= lowest).withColumn("_stack", F.explode(F.sequence(lowest, highest)))
    places = stacks.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    held = places.where(F.greatest(F.lit(0), F.least(F.col("_stack") * n + F.col("_place") - left, F.col("_all") - 1)) == at)
    made = held.groupBy(key, F.col("_stack").cast("int").alias("_stack")).agg(F.array_sort(F.collect_list(F.struct(F.col("_place"), F.col(vec).alias("_vec")))).alias("_own"))
    return made.select(key, F.col("_stack").alias(frame), F.flatten(F.transform("_own", lambda x: x["_vec"])).alias("stacked"))


def moments(rows: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """Each key's shift (minus the mean) and scale (1 / deviation) by dimension, as arrays: one aggregate, no row per dimension.

    A deviation below ``LEAST_DEVIATION`` counts as that, so a constant dimension and a single frame become zeros.
    """
    each = [F.get(vec, F.lit(d)) for d in range(width)]
    return rows.groupBy(key).agg(F.array(*[-F.avg(x) for x in each]).alias("shift"), F.array(*[1 / F.greatest(F.stddev_pop(x), F.lit(LEAST_DEVIATION)) for x in each]).alias("scale"))


def numbered(rows: DataFrame, key: str, order: str, name: str = "frame", total: str | None = None) -> DataFrame:
    """Number each key's rows from 0; ``total`` names a column for how many there are."""
    return ordered.number(rows, key, order, name, total=total)


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Fixed-size batches of each key's rows, in order."""
    return numbered(rows, key, order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def length_buckets(rows: DataFrame, length: str, parts: int) -> DataFrame:
    """Rows dealt so that those of like length are together, for padded batches: a range partitioning, sorted inside."""
    return rows.repartitionByRange(parts, length).sortWithinPartitions(length)


def valid_frames(rows: DataFrame, frame: str, length: str) -> DataFrame:
    """What a length mask keeps."""
    return rows.where(F.col(frame) < F.col(length))


def pieces_to_text(rows: DataFrame, vocabulary: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """Ids by their pieces, in order; ids outside the vocabulary are left out."""
    found = rows.join(vocabulary, rows[token] == vocabulary["id"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "piece"))).alias("own"))
    return found.select(key, F.transform("own", lambda x: x["piece"]).alias("pieces"))


def language_runs(rows: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """Runs of English and of other tokens, as arrays: what a segmenter of either language gets at once."""
    numbered_rows = _with_runs(rows.withColumn("english", is_english(F.col(token))), key, order, "english")
    gathered = numbered_rows.groupBy(key, "run", "english").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("t")))).alias("own"))
    return gathered.select(key, "run", "english", F.transform("own", lambda x: x["t"]).alias("tokens"))


def language_runs_of_arrays(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """``language_runs`` of rows that hold their tokens as an array, ordered by their places in it.

    A row whose key is its own is cut where it is: nothing of it is shuffled but the key. Rows that share a key, a null key included, mix
    their tokens by place, which ``language_runs`` does over a row per token.
    """
    repeated = rows.groupBy(F.col(key).alias("_repeated")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_repeated")
    many = repeated.limit(MOST_SENT + 1).count()
    cut = lambda own: own.select(key, F.inline(texts.language_runs(F.col(tokens))))
    if not many:
        return cut(rows)
    known = F.broadcast(repeated) if many <= MOST_SENT else repeated
    same = rows[key].eqNullSafe(known["_repeated"])
    mixed = rows.join(known, same, "left_semi").select(key, F.posexplode(tokens).alias("_place", "_token"))
    return cut(rows.join(known, same, "left_anti")).unionByName(language_runs(mixed, key, "_place", "_token"))
