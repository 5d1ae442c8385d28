"""Keyed joins in place of matching by row position, and sub-word masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright import constants as K
from claimwright.functions import arrays as A
from claimwright.sources import versions


def join_parts(parts: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Inner join of split, feature, mask and metadata tables on the row key."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key)
    return out


def join_stored_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Inner join of tables stored in buckets of one key: bucket meets bucket, nothing is shuffled.

    The tables must have been written with the same key and number of buckets.
    """
    layouts = {(v.note.get("key"), v.note.get("buckets")) for v in (versions.current(spark, p) for p in paths) if v}
    if len(layouts) != 1 or (None, None) in layouts:
        raise ValueError(f"parts are stored by different keys or in different numbers of buckets: {sorted(layouts, key=str)}")
    ((key, _),) = layouts
    out = versions.read_bucketed(spark, paths[0])
    for path in paths[1:]:
        # The hint keeps Spark from sending a part to all tasks where it is small.
        out = out.join(versions.read_bucketed(spark, path).hint("merge"), key)
    return out


def alignment_gaps(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys without a partner in each direction; both counts must be 0."""
    only_a = a.select(key).join(b.select(key), key, "left_anti").select(F.lit("first").alias("side"))
    only_b = b.select(key).join(a.select(key), key, "left_anti").select(F.lit("second").alias("side"))
    return only_a.unionByName(only_b).agg(
        F.count_if(F.col("side") == "first").alias("only_first"),
        F.count_if(F.col("side") == "second").alias("only_second"),
    )


def rows_by_key(df: DataFrame, wanted: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of ``df`` whose key is wanted, e.g. those behind a set of cards."""
    return df.join(wanted.select(key), key, "left_semi")


def subword_masks(
    df: DataFrame,
    tags: str,
    word_index: str,
    key: str = "row_id",
    extra: list[str] | None = None,
) -> DataFrame:
    """Three channel masks on sub-word slots and their total per row, in one select."""
    masks = {
        c: A.project_mask(A.channel_mask(F.col(tags), c), F.col(word_index)) for c in K.CHANNELS
    }
    out = df.select(key, *(extra or []), *[m.alias(c) for c, m in masks.items()])
    total = sum((A.mask_total(F.col(c)) for c in K.CHANNELS[1:]), A.mask_total(F.col("emotion")))
    return out.withColumn("concept_tokens_per_row", total)


def project_mask_long(mask: DataFrame, slots: DataFrame, key: str = "row_id") -> DataFrame:
    """Long form: ``mask(row_id, word, value)`` seen from ``slots(row_id, slot, word)``."""
    return slots.join(mask, [key, "word"], "left").select(
        key, "slot", F.coalesce("value", F.lit(0)).alias("value")
    )
