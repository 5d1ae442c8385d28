"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, tokens.

Each stage works on all that its predecessor kept. The filtering stages return the
columns of ``documents``; the last returns the token ids.

In every stage null texts count as empty and a null ``doc_id`` compares like a value; rows of one
``doc_id`` share one decision, and go if one of them is to go. Further columns pass unread (the
last stage drops them), and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.llm import decontaminate, exact_dedup, near_dup, pieces
from claimwright.llm.common import without
from claimwright.llm.queries import quality_scores, table
from claimwright.session import scratch_path

MIN_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below ``MIN_QUALITY``."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where(F.col("score") < MIN_QUALITY))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return without(docs, exact_dedup.mark_duplicates(docs).where(~F.col("kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays."""
    classes = near_dup.near_duplicates(docs)
    return without(docs, classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and the hash of what they decode to."""
    import public_tokenizers

    return pieces.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The first stage trains a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
