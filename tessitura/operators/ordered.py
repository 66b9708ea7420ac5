"""Running values over a key's rows, in ranges of the order.

A window by key alone puts all rows of a key into one task. Here a key's rows are cut into ranges of a numeric order
column; windows run inside a range, and what the former ranges hand over (a count, a sum, a last value) is found over
one row per range and joined to it. A key with a third of all rows is so windowed in parts.

A null key is a key like others. Rows whose order is null come first, in any order among themselves. ``ties`` name columns
that order rows of equal ``order``. ``over_neighbours`` wants gapless numbers and leaves out rows without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range, in units of the order column.
RANGE = 65_536


def _cut(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_range", F.floor(F.col(order) / F.lit(RANGE)))


def _hand_over(cut: DataFrame, key: str, own: Column, former: Column) -> DataFrame:
    """``cut`` with ``_former``: ``former`` over the ``_own`` values of the key's earlier ranges, in order."""
    ranges = cut.groupBy(key, "_range").agg(own.alias("_own")).withColumn("_former", former).drop("_own")
    own = ranges.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), "_former")
    return cut.join(own, cut[key].eqNullSafe(own["_key"]) & cut["_range"].eqNullSafe(own["_at"]), "left").drop("_key", "_at")


def _earlier(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def number(rows: DataFrame, key: str, order: str, name: str, ties: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Number each key's rows from 0; ``total`` names a column for how many rows the key has."""
    cut = _cut(rows, order)
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order, *ties)) - 1
    before = F.coalesce(F.sum("_own").over(_earlier(key)), F.lit(0))
    handed = _hand_over(cut, key, F.count(F.lit(1)), F.struct(before.alias("n"), F.sum("_own").over(Window.partitionBy(key)).alias("all")) if total else before)
    if not total:
        return handed.withColumn(name, (inside + F.col("_former")).cast("long")).drop("_range", "_former")
    return handed.withColumn(name, (inside + F.col("_former.n")).cast("long")).withColumn(total, F.col("_former.all").cast("long")).drop("_range", "_former")


def running_sum(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The sum of a whole-number ``value`` up to and with each row."""
    cut = _cut(rows, order)
    inside = F.sum(value).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    handed = _hand_over(cut, key, F.sum(value), F.coalesce(F.sum("_own").over(_earlier(key)), F.lit(0)))
    return handed.withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_former")).drop("_range", "_former")


def running_max(rows: DataFrame, key: str, order: str, value: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """The largest ``value`` before each row; null where there is none. ``order``, then ``ties``, tell rows apart."""
    cut = _cut(rows, order)
    inside = F.max(value).over(Window.partitionBy(key, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    handed = _hand_over(cut, key, F.max(value), F.max("_own").over(_earlier(key)))
    return handed.withColumn(name, F.greatest(inside, "_former")).drop("_range", "_former")


def previous(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The ``value`` of the row before, in a struct: null for a key's first row, whatever the value."""
    cut = _cut(rows, order)
    own = Window.partitionBy(key, "_range").orderBy(order)
    boxed = F.struct(F.col(value).alias("value"))
    handed = _hand_over(cut, key, F.max_by(boxed, F.col(order)), F.last("_own", ignorenulls=True).over(_earlier(key)))
    return handed.withColumn(name, F.coalesce(F.lag(boxed).over(own), F.col("_former"))).drop("_range", "_former")


def latest(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The last ``value`` that isn't null, up to and with each row."""
    cut = _cut(rows, order)
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    given = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
    handed = _hand_over(cut, key, given, F.last("_own", ignorenulls=True).over(_earlier(key)))
    return handed.withColumn(name, F.coalesce(inside, "_former")).drop("_range", "_former")


def over_neighbours(rows: DataFrame, key: str, order: str, before: int, after: int, name: str, value: Callable[[Window], Column]) -> DataFrame:
    """``value`` of a window that sees at most ``before`` earlier and ``after`` later rows.

    ``order`` numbers a key's rows without gaps. A range also gets its neighbours' rows within that margin, and gives
    results for its own rows only.
    """
    first, last = (F.floor((F.col(order) + F.lit(shift)) / F.lit(RANGE)) for shift in (-after, before))
    spread = rows.withColumn("_range", F.explode(F.sequence(first, last)))
    found = spread.withColumn(name, value(Window.partitionBy(key, "_range").orderBy(order)))
    return found.where(F.col("_range") == F.floor(F.col(order) / F.lit(RANGE))).drop("_range")


def fold_groups(rows: DataFrame, key: str, order: Sequence[str], fold: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fold(key, batches)`` over each key's rows in ``order``, for results that depend on all former rows.

    The sort is Spark's, and spills; Python gets a key's rows batch by batch and gives batches back, so neither holds a
    key whole. Keys run side by side; one key's rows are worked on in one task, since each waits for the one before.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(key[0].as_py(), batches)

    return rows.repartition(key).sortWithinPartitions(key, *order).groupBy(key).applyInArrow(run, schema)
