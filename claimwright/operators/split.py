"""Deterministic stratified train/val/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright import constants as K
from claimwright.operators.ranking import at_or_before, stratum_cuts

SPLITS = ["train", "val", "test"]


def percent_of(n, percent: int):
    """``round(n * percent / 100)`` in whole numbers."""
    return F.floor((n * percent + 50) / 100)


def stratified_split(
    df: DataFrame,
    strata: list[str],
    key: str = "row_id",
    train: int = 70,
    val: int = 15,
    seed=K.SEED,
) -> DataFrame:
    """Add ``split``: the first 70 % of each stratum in hash order train, and so on.

    Two narrow passes find the two boundary rows per stratum; the rows
    themselves are then labelled in place, without a shuffle. Pass a stored
    table: the input is read three times.
    """
    cuts = stratum_cuts(
        df,
        strata,
        key,
        seed,
        {"_train": percent_of(F.col("n"), train), "_val": percent_of(F.col("n"), train + val)},
    ).drop("n", "total", "strata_count", "stratum_no")
    split = (
        F.when(at_or_before("_train", key, seed), "train")
        .when(at_or_before("_val", key, seed), "val")
        .otherwise("test")
    )
    return df.join(cuts, strata).withColumn("split", split).drop("_train", "_val")


def split_leaks(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys that sit in more than one split; must be empty.

    The flags are numbers, so the aggregate keeps its hash form.
    """
    flags = [F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    return df.groupBy(key).agg(*flags).filter(F.col("train") + F.col("val") + F.col("test") > 1)


def text_leaks(df: DataFrame, text: str) -> DataFrame:
    """Hashes of texts that sit in more than one split, though their rows differ."""
    hashed = df.select("split", F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    flags = [F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    return hashed.groupBy("_h1", "_h2").agg(*flags).filter(F.col("train") + F.col("val") + F.col("test") > 1)


def length_variants(df: DataFrame, tokens: str, lengths: list[int] | None = None) -> DataFrame:
    """Every row once per length ``L``, its tokens cut to that length."""
    spine = F.explode(F.array(*[F.lit(n) for n in lengths or K.SEQUENCE_LENGTHS]))
    return df.withColumn("L", spine).withColumn(
        "truncated_tokens", F.slice(F.col(tokens), F.lit(1), F.col("L"))
    )
