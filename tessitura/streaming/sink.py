"""A sink whose micro-batches can be written again: results as JSON frames, broken pushes beside them.

A micro-batch owns one folder under each output, named by its id. Writing it replaces the folder, so a batch that a restarted
query repeats leaves each frame once; readers see the folders as the column ``batch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

FRAME_FIELDS = ["type", "text", "raw_text", "start_ms", "end_ms"]


def result_frames(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, seq, value: partial and final results as the JSON frames that a client gets."""
    shown = rows.where(F.col("kind").isin("partial", "final")).withColumn("type", F.col("kind"))
    frames = F.to_json(F.struct(*FRAME_FIELDS))
    return shown.select(key, "seq", frames.alias("value"))


def control_frames(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, seq, value: answers to commands."""
    said = rows.where(F.col("kind").isin("ready", "config", "eof", "reset"))
    value = F.to_json(F.struct(F.col("kind").alias("type"), F.col("text").alias("format")))
    return said.select(key, "seq", value.alias("value"))


def error_frames(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, seq, value: what was wrong with pushes that were skipped."""
    broken = rows.where(F.col("kind") == "error")
    return broken.select(key, "seq", F.to_json(F.struct(F.col("kind").alias("type"), F.col("text").alias("message"))).alias("value"))


class FrameSink:
    """``foreachBatch`` writer of results and errors."""

    def __init__(self, path: str, key: str = "stream_id"):
        self.path, self.key = path.rstrip("/"), key

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            for name, made in (("results", result_frames(rows, self.key).unionByName(control_frames(rows, self.key))), ("errors", error_frames(rows, self.key))):
                made.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()


def write_frames(rows: DataFrame, path: str, checkpoint: str, key: str = "stream_id") -> DataStreamWriter:
    """The rows of ``stream_audio`` to ``path``; start it with ``start()``."""
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(FrameSink(path, key))


def read_written(spark: SparkSession, path: str, name: str = "results", key_type: str = "string", key: str = "stream_id") -> DataFrame:
    """The frames that were written, each once."""
    return spark.read.schema(f"`{key}` {key_type}, seq long, value string, batch long").parquet(f"{path.rstrip('/')}/{name}")
