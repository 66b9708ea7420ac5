"""Latency samples: summaries, exact percentiles, and the largest load within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarise(samples: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    """Count, mean, median, p95, least and largest by key; percentiles interpolate linearly."""
    v = F.col(value).cast("double")
    return samples.groupBy(key).agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), digits).alias("mean_ms"),
        F.round(F.percentile(v, 0.5), digits).alias("median_ms"),
        F.round(F.percentile(v, 0.95), digits).alias("p95_ms"),
        F.round(F.min(v), digits).alias("min_ms"),
        F.round(F.max(v), digits).alias("max_ms"),
    )


def recommend(measured: DataFrame, budget: str, frames: str = "frames", p95: str = "p95_ms", by: str = "label") -> DataFrame:
    """Per label: the largest load whose p95 is within its budget, and the load interpolated towards the next one.

    Nulls where even the smallest load is beyond the budget, or where there is no larger load to interpolate to.
    """
    own = Window.partitionBy(by).orderBy(frames)
    ahead = measured.withColumn("_next", F.lead(frames).over(own)).withColumn("_next_p95", F.lead(p95).over(own))
    fits = F.col(p95) <= F.col(budget)
    best = ahead.groupBy(by).agg(F.max(budget).alias("budget_ms"), F.max_by(F.struct(frames, p95, "_next", "_next_p95"), F.when(fits, F.col(frames))).alias("b"), F.count_if(fits).alias("n_fitting"))
    span = F.col("b._next_p95") - F.col(f"b.{p95}")
    between = F.floor(F.col(f"b.{frames}") + (F.col("budget_ms") - F.col(f"b.{p95}")) / span * (F.col("b._next") - F.col(f"b.{frames}"))).cast("long")
    some = F.col("n_fitting") > 0
    return best.select(by, "budget_ms", F.when(some, F.col(f"b.{frames}")).alias("max_measured_frames"), F.when(some & (span > 0), between).alias("interpolated_frames"))
