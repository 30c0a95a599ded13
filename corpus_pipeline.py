"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result
is written as Parquet in the shared folder and read again as the next one's ``docs``.  Extra columns
pass through; an empty table gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontam, minhash, packing, quality, secrets
from glyphlake.llm.storage import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents out of line with their language and source go; a null text has failed."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; rows without an id, and one row of each
    id and wordless text, stay, too."""
    return minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row for its own text, whatever its id."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows, null for a null text."""
    return secrets.mask(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, near_dedup, decontamination, secret_scan, best_fit_packing)]

#: SQL has no subword tokenizer; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
