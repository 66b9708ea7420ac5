"""The corpus pipeline: ``documents`` through quality, near duplicates, decontamination, secrets and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of ``docs``. Null and empty texts, repeated rows, empty tables and extra columns are met as the operators' docstrings
say. Near duplicates are found among rows: rows with a null doc_id take part, and of an id with several texts each is
judged for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import decontamination, jaccard_join, packing, quality, secret_scan
from tessitura.llm.common import materialise


#: The name of the row numbers inside a stage.
ROW = "_tessitura_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least doc_id, nulls last. Rows are told apart by a number, not by id."""
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = materialise(jaccard_join.jaccard_components(rows.select(ROW, "text"), doc_id=ROW).select(F.col("doc_id").alias(ROW), "component_id"), "components")
    ids = found.join(rows.select(ROW, "doc_id"), ROW)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW))
    gone = materialise(found.join(kept, ROW, "left_anti").select(ROW), "gone")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their sequence and place."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Stages 1 and 5 (a trained classifier, a tokenizer) can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
