"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.llm import bloom
from claimwright.session import settle


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def fold(id_: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def salted(frame: DataFrame, salts: int, name: str = "__salt") -> DataFrame:
    """Every row once per salt: the small side of a join whose other side is dealt out."""
    return frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in column ``id_col`` of ``ids``; nulls compare like values.

    Rows that a Bloom filter of the ids rules out pass where they are; only possible
    hits are shuffled to an exact anti join. So a few ids do not move all texts.
    """
    gone = settle(ids.select(F.col(id_col).alias("__gone")).distinct())
    key = F.xxhash64(F.struct("__gone"))
    probed = bloom.maybe_listed(
        docs.withColumn("__key", F.xxhash64(F.struct(F.col(id_col).alias("__gone")))), "__key", bloom.build(gone.select(key.alias("__key")), "__key")
    )
    stay = probed.where(~F.col("__maybe")).select(docs.columns)
    possible = probed.where("__maybe").select(docs.columns)
    return stay.unionAll(possible.join(gone, possible[id_col].eqNullSafe(F.col("__gone")), "left_anti"))
