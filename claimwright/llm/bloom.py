"""Blocked Bloom filter as a table, with DataFrame functions only.

A key belongs to one block of 256 bits, kept as four longs, and sets one bit in each
of the four. The filter has at most ``blocks`` rows, whatever the number of keys, so
broadcasting it is bounded by the parameter: 65,536 blocks are about 5 MB. With more
keys the share of false hits grows; callers remove those by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 4
MAX_BLOCKS = 1 << 16


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    bits = F.xxhash64(key, F.lit(word // 2))
    return F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 8 * (word % 2)).bitwiseAND(63).cast("int")
    )


def build(keys: DataFrame, key: str, blocks: int = MAX_BLOCKS) -> DataFrame:
    """The filter of the non-null values of ``key``: ``(block, w0..w3)``; empty for no keys."""
    if not 0 < blocks <= MAX_BLOCKS:
        raise ValueError(f"blocks must be in 1..{MAX_BLOCKS}")
    k = F.col(key)
    masks = keys.where(k.isNotNull()).select(
        _block(k, blocks).alias("__block"), *(_mask(k, w).alias(f"__w{w}") for w in range(WORDS))
    )
    return masks.groupBy("__block").agg(*(F.bit_or(f"__w{w}").alias(f"__w{w}") for w in range(WORDS)))


def maybe_listed(rows: DataFrame, key: str, filter_: DataFrame, blocks: int = MAX_BLOCKS, flag: str = "__maybe") -> DataFrame:
    """Adds ``flag``: false only for keys that are certainly not in the filter; false for null."""
    k = F.col(key)
    hit = F.lit(True)
    for w in range(WORDS):
        mask = _mask(k, w)
        hit = hit & (F.col(f"__w{w}").bitwiseAND(mask) == mask)
    probed = rows.withColumn("__probe", _block(k, blocks)).join(
        F.broadcast(filter_), F.col("__probe") == F.col("__block"), "left"
    )
    names = ["__probe", "__block", *(f"__w{w}" for w in range(WORDS))]
    return probed.withColumn(flag, F.coalesce(hit, F.lit(False)) & k.isNotNull()).drop(*names)
