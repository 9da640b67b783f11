"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, written as Parquet and read again as the next stage's ``docs``. All but
the last give the columns of ``documents``. The stages handle nulls, empty texts, repeated rows, empty tables and extra columns as the
operators behind them say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framelane.llm import byte_bpe, mixing, pii_anchors, quality_risk, simhash_groups
from framelane.llm.shared import shared_folder

#: SQL cannot express the thresholds' bounds, fingerprints, masks and tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def in_small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: Arrow batches of 2,000 rows instead of 10,000 keep JVM and Python buffers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the risk-controlled cutoffs of their language."""
    return quality_risk.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest id."""
    in_small_batches(spark)
    return simhash_groups.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the personal data masked; ``n_chars``, if there, follows the new text."""
    in_small_batches(spark)
    return pii_anchors.mask_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them, dealt to shards."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row the token ids, and the digest of the bytes that they decode to."""
    import public_tokenizers

    in_small_batches(spark)
    return byte_bpe.token_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
