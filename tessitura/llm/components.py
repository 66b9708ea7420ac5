"""Connected components of a link table by alternating large and small stars; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on the least node that it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    kept = both.join(least, "a")
    if large:
        hung = kept.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        smaller = kept.where("b < a").select(F.col("b").alias("v"), "m").unionByName(least.select(F.col("a").alias("v"), "m"))
        hung = smaller.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (columns a, b of any order)."""
    now = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    before, first = _digest(now), now
    for _ in range(rounds):
        if not before[0]:
            break
        later = materialise(_star(_star(now, True), False), "links")
        after = _digest(later)
        if now is not first:
            discard(now)
        now = later
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components haven't settled")
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return hung.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
