"""Resampling that gives every (domain, class) bucket the same share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimwright import constants as K
from claimwright.operators.ranking import (
    MAX_STRATA,
    at_or_before,
    bucketed_rank,
    hash_order,
    stratum_cuts,
)
from claimwright.session import broadcast_if_small, settle

BUCKET = ["has_meta", "label"]
COPY_BLOCK = 1_000
SMALL_BUCKET = 20_000
MAX_SMALL_ROWS = 200_000


def bucket_sizes(df: DataFrame, domains=((1, "political"), (0, "health"))) -> DataFrame:
    """Rows per domain and class, all four cells, 0 where a bucket is empty."""
    cells = F.array(
        *[
            F.struct(
                F.lit(flag).alias("has_meta"), F.lit(name).alias("domain"),
                F.lit(label).alias("label"), F.lit(cls).alias("class"),
            )
            for flag, name in domains
            for label, cls in ((0, "fake"), (1, "real"))
        ]
    )
    counts = df.groupBy(*BUCKET).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1).select(F.inline(cells))
    return spine.join(counts, BUCKET, "left").select(
        "domain", "class", F.coalesce("n", F.lit(0)).alias("n")
    )


def balance_weights(df: DataFrame, bucket: list[str] | None = None) -> DataFrame:
    """Weight ``1 / bucket size`` per bucket."""
    return df.groupBy(*(bucket or BUCKET)).agg(
        F.count("*").alias("n"), (F.lit(1.0) / F.count("*")).alias("weight")
    )


def balanced_exact(
    df: DataFrame,
    key: str = "row_id",
    bucket: list[str] | None = None,
    seed=K.SEED,
    block: int = COPY_BLOCK,
) -> DataFrame:
    """As many rows as the input, shared evenly between the buckets.

    Each row is repeated ``floor(target / n)`` times and the first rows in hash
    order once more, so that the totals come out exactly. Copies are numbered in
    ``copy``. With fewer than two buckets the rows come back once each.

    Rows are copied where they are. Only a row that is due more than ``block``
    copies, because its bucket is tiny, is first cut into blocks of copies that
    are dealt out over the tasks.
    """
    bucket = bucket or BUCKET
    n, total, k, no = (F.col(c) for c in ("n", "total", "strata_count", "stratum_no"))
    target = F.floor(total / k) + (no <= total % k).cast("long")
    spare = F.when(k < 2, F.lit(0)).otherwise(target % n)
    cuts = stratum_cuts(df, bucket, key, seed, {"_spare": spare})
    copies = F.when(k < 2, F.lit(1)).otherwise(
        F.floor(target / n) + at_or_before("_spare", key, seed).cast("long")
    )
    due = (
        df.join(cuts, bucket)
        .withColumn("_copies", copies.cast("long"))
        .drop("n", "total", "strata_count", "stratum_no", "_spare")
    )
    # A filter first: sequence(1, 0) would count down.
    few = due.filter(F.col("_copies").between(1, block)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    )
    last_block = F.floor((F.col("_copies") - 1) / block)
    many = (
        due.filter(F.col("_copies") > block)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition(key, "_block")
        .withColumn(
            "copy",
            F.explode(
                F.sequence(
                    F.col("_block") * block + 1,
                    F.least((F.col("_block") + 1) * block, F.col("_copies")),
                )
            ),
        )
        .drop("_block")
    )
    return few.unionByName(many).drop("_copies")


def _uniform(key, seed):
    """Whole number below 2**52 from the hash of a key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("decimal(20,0)")


def balanced_draws(
    df: DataFrame,
    key: str = "row_id",
    bucket: list[str] | None = None,
    seed=K.SEED,
    small: int = SMALL_BUCKET,
) -> DataFrame:
    """One draw with replacement per input row, every bucket equally likely.

    Each input row stands for one draw: its hash picks a bucket and a rank in
    that bucket, and a join on (bucket, rank) fetches the drawn row. A row of a
    tiny bucket is drawn very often, so the rows of small buckets are broadcast;
    those of large ones are drawn rarely each, and their join key spreads evenly.
    Returns no rows with fewer than two buckets.
    """
    bucket = bucket or BUCKET
    sizes = df.groupBy(*bucket).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_no", F.row_number().over(Window.orderBy(*bucket)) - 1)
    sizes = sizes.withColumn(
        "_k",
        F.count("*").over(
            Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    ).filter(F.col("_k") > 1)
    sizes = broadcast_if_small(sizes, MAX_STRATA)
    wide = F.lit(2**52).cast("decimal(20,0)")

    def scaled(draw_seed, size):
        """The hash of the draw, scaled to a whole number below ``size``."""
        hashed = _uniform(F.col("draw"), draw_seed) * F.col(size).cast("decimal(18,0)")
        return F.call_function("div", hashed, wide)

    k = sizes.agg(F.max("_k").alias("_k"))
    slots = (
        df.select(F.col(key).alias("draw"))
        .crossJoin(F.broadcast(k))  # one row
        .withColumn(
            "_no",
            scaled(f"{seed}-bucket", "_k").cast("int"),
        )
        .drop("_k")
        .join(sizes.drop("_k"), "_no")
        .withColumn(
            "_rank",
            scaled(f"{seed}-row", "_n") + 1,
        )
        .select("draw", *bucket, "_rank", "_n")
    )
    ranked = bucketed_rank(df, bucket, key, f"{seed}-rank", out="_rank")
    ranked = settle(ranked.join(sizes.select(*bucket, "_n"), bucket))
    on = [*bucket, "_rank"]
    tiny = broadcast_if_small(ranked.filter(F.col("_n") <= small).drop("_n"), MAX_SMALL_ROWS)
    often = slots.filter(F.col("_n") <= small).drop("_n").join(tiny, on)
    rarely = slots.filter(F.col("_n") > small).drop("_n").join(
        ranked.filter(F.col("_n") > small).drop("_n"), on
    )
    return often.unionByName(rarely).drop("_rank")
