"""Pooling of token vectors and attention over groups of any size.

A group may hold a large part of the data, so nothing here collects a group:
every step is an aggregate that combines on the map side, or a join whose other
side has one row per group.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from claimwright.session import broadcast_if_small

MAX_GROUPS = 1_000_000
LOWEST_FLOAT = -3.4028234663852886e38


def masked_pool(df: DataFrame, group: str, vec: str, mask: str, size: int) -> DataFrame:
    """Mean and max of the unmasked vectors of each group, joined into one array.

    A group without any unmasked vector gets zeros for the mean and the lowest
    float for the max.
    """
    real = df.filter(F.col(mask) > 0).select(group, array_to_vector(vec).alias("_v"))
    pooled = real.groupBy(group).agg(
        Summarizer.metrics("mean", "max").summary(F.col("_v")).alias("_s")
    )
    pooled = pooled.select(
        group,
        F.concat(vector_to_array("_s.mean"), vector_to_array("_s.max")).alias("_pooled"),
    )
    empty = F.concat(
        F.array_repeat(F.lit(0.0), size), F.array_repeat(F.lit(LOWEST_FLOAT), size)
    )
    return (
        df.select(group)
        .distinct()
        .join(pooled, group, "left")
        .select(group, F.coalesce("_pooled", empty).alias("pooled"))
    )


def masked_pool_rows(vecs, mask, size: int):
    """The same for a row that holds its token vectors, as a Column with no shuffle."""
    pairs = F.filter(F.arrays_zip(vecs.alias("v"), mask.alias("m")), lambda z: z["m"] > 0)
    n = F.greatest(F.size(pairs), F.lit(1))
    zeros = F.array_repeat(F.lit(0.0), size)
    lows = F.array_repeat(F.lit(LOWEST_FLOAT), size)
    total = F.aggregate(
        pairs, zeros, lambda a, z: F.zip_with(a, z["v"], lambda x, y: x + y.cast("double"))
    )
    peak = F.aggregate(
        pairs, lows,
        lambda a, z: F.zip_with(a, z["v"], lambda x, y: F.greatest(x, y.cast("double"))),
    )
    return F.concat(F.transform(total, lambda x: x / n), peak)


def masked_softmax(df: DataFrame, group: list[str], score: str, mask: str) -> DataFrame:
    """Add ``alpha``: softmax of the scores over the masked rows of each group.

    Sums are first kept per whole-number step of the score, relative to that
    step, so the peak need not be known yet and the rows are aggregated once.
    The weights join back against one row per group, broadcast if those are few.
    """
    real = df.filter(F.col(mask) > 0)
    step = F.floor(F.col(score)).alias("_step")
    partial = real.groupBy(*group, step).agg(
        F.sum(F.exp(F.col(score) - F.floor(F.col(score)))).alias("_sum")
    )
    peaks = partial.groupBy(*group).agg(F.max("_step").alias("_peak"))
    totals = (
        partial.join(peaks, group)
        .groupBy(*group, "_peak")
        .agg(F.sum(F.col("_sum") * F.exp(F.col("_step") - F.col("_peak"))).alias("_total"))
    )
    totals = broadcast_if_small(totals, MAX_GROUPS)
    alpha = F.when(
        F.col(mask) > 0, F.exp(F.col(score) - F.col("_peak")) / F.col("_total")
    ).otherwise(F.lit(0.0))
    return df.join(totals, group, "left").withColumn("alpha", alpha).drop("_peak", "_total")


def weighted_context(df: DataFrame, group: list[str], vec: str, weight: str, size: int) -> DataFrame:
    """Sum of the vectors of a group, each times its weight; zeros where no weight is set."""
    used = df.filter(F.col(weight) > 0).select(
        *group, array_to_vector(vec).alias("_v"), F.col(weight).alias("_w")
    )
    summed = used.groupBy(*group).agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("_mean"),
        F.sum("_w").alias("_sum"),
    )
    context = F.transform("_mean", lambda x: x * F.col("_sum"))
    return (
        df.select(*group)
        .distinct()
        .join(summed, group, "left")
        .select(
            *group,
            F.coalesce(context, F.array_repeat(F.lit(0.0), size)).alias("context"),
        )
    )
