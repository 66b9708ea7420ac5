"""The folder that all executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new place below ``spark.checkpoint.dir``; where that is unset, a local run makes a temporary folder and a cluster run fails."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='tessitura-')}"
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/tessitura-files/{what}-{uuid.uuid4().hex}"
