"""Error rates of hypotheses against references: joins, an edit distance, ratios of sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.arrays import let
from tessitura.functions.text import edit_distance, normalize


def reference_key(numeric_id: Column, key: Column) -> Column:
    """A numeric id as three digits at least; otherwise the key. Text ids are ignored in favour of the key."""
    return F.when(numeric_id.isNotNull(), F.format_string("%03d", numeric_id)).otherwise(key)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out evenly, in as many partitions as a shuffle has; adaptive execution may not join them again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_pairs(refs: DataFrame, hyps: DataFrame, keys: list[str], letters: str = r"\p{L}\p{N}_") -> DataFrame:
    """Inner join on the keys; edits and reference length of each pair. Unmatched rows of either side are left out.

    The edit distance costs far more than moving its row, so few input partitions are spread over all cores first.
    """
    joined = spread(hyps.select(*keys, F.col("hyp"))).join(refs, keys)
    normal = joined.withColumn("_pair", F.struct(normalize(F.col("ref"), letters).alias("r"), normalize(F.col("hyp"), letters).alias("h")))
    found = normal.withColumn("edits", let(F.col("_pair"), lambda p: edit_distance(p["r"], p["h"])).cast("long"))
    return found.withColumn("ref_chars", F.length("_pair.r").cast("long")).drop("_pair")


def micro_rate(scored: DataFrame, *by: str) -> DataFrame:
    """100 times all edits over all reference characters, by group: a ratio of sums."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("edits").alias("edits"),
        F.sum("ref_chars").alias("ref_chars"),
        F.round(100.0 * F.sum("edits") / F.greatest(F.sum("ref_chars"), F.lit(1)), 6).alias("micro_cer"),
    )


def real_time(scored: DataFrame, times: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Compute time over audio time and its inverse, over the pairs that have a timing; null where a sum is 0."""
    matched = scored.join(times, keys, "left").withColumn("audio", F.when(F.col("seconds").isNotNull(), F.col("duration")))
    return matched.groupBy(*by).agg(
        F.count("seconds").alias("n_timed"),
        F.round(F.try_divide(F.sum("seconds"), F.sum("audio")), 6).alias("rtf"),
        F.round(F.try_divide(F.sum("audio"), F.sum("seconds")), 6).alias("speed_up"),
    )
