"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Refinement reads little first. Length and prefix hash of every normalised text give
one narrow count per pair; texts alone in their pair are unique and are not hashed
further. Only for texts of surviving pairs is the whole content hashed. The survivors
reach the scan as a blocked Bloom filter of fixed size, so no text is shuffled and
nothing that grows with the data is broadcast; its false hits only cost a hash.

Counts have map-side partials, so a group with a third of all rows sends one row per
task. The group's result goes back to its rows by a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.llm import bloom
from claimwright.llm.common import salted, text_or_empty

SALTS = 16

#: Runs of white space that change: a lone space stays as it is.
_CHANGING_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null is empty; every run of ``[\\x20\\x09-\\x0D]`` is one space."""
    return F.regexp_replace(text_or_empty(text), _CHANGING_SPACE, " ")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, blocks: int = bloom.MAX_BLOCKS
) -> DataFrame:
    """Groups of two or more equal texts: ``(text_sha256, keep_id, group_size)``.

    ``keep_id`` is the smallest id; null ids count as members but stay only where all
    ids of a group are null. Null texts count as empty, empty texts equal each other,
    repeated rows are members each. An empty table gives no groups. Other columns of
    ``docs`` are not read. Long texts are never cut: the prefix only decides which
    texts are read in full.
    """
    texts = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__norm"))
    keyed = texts.select(
        "__id",
        "__norm",
        F.octet_length("__norm").alias("__length"),
        F.xxhash64(F.substring("__norm", 1, prefix_chars)).alias("__prefix"),
    ).withColumn("__pair", F.xxhash64("__length", "__prefix"))
    shared = keyed.groupBy("__length", "__prefix", "__pair").agg(F.count("*").alias("__n")).where("__n > 1")
    survivors = bloom.maybe_listed(keyed, "__pair", bloom.build(shared, "__pair", blocks), blocks).where("__maybe")
    return (
        survivors.select("__id", sha256_of(F.col("__norm")).alias("text_sha256"))
        .groupBy("text_sha256")
        .agg(F.min("__id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    A row that repeats the kept row in id and text is marked as kept too: it is the
    same row. A lone text has itself as ``keep_id`` and size 1.
    """
    groups = duplicate_groups(docs, id_col, text_col, **options)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        sha256_of(normalised(F.col(text_col))).alias("text_sha256"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    found = rows.join(salted(groups, SALTS), ["text_sha256", "__salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
