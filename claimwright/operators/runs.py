"""Queries over run records: seeds, ablations, best epoch, early stop, latest log entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimwright import constants as K

RUN = ["tag", "seed"]


def seed_summary(results: DataFrame, by: str = "tag", value: str = "test_macro_f1") -> DataFrame:
    """Mean, sample deviation and number of runs per tag."""
    return results.groupBy(by).agg(
        F.round(F.avg(value), 8).alias("mean"),
        F.round(F.stddev_samp(value), 8).alias("std"),
        F.count(value).alias("n"),
    )


def ablation_matrix(results: DataFrame, rows: str, columns: str, values: list[str], value: str = "test_macro_f1") -> DataFrame:
    """Mean score with one row per phase and one column per setting."""
    return results.groupBy(rows).pivot(columns, values).agg(F.round(F.avg(value), 8))


def best_epoch(epochs: DataFrame, run: list[str] | None = None, score: str = "val_macro_f1") -> DataFrame:
    """First epoch with the highest score of each run."""
    run = run or RUN
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("epoch")).alias("e")))
    return epochs.groupBy(*run).agg(best.alias("_b")).select(
        *run, (-F.col("_b.e")).alias("best_epoch"), F.round("_b.s", 6).alias("best_score")
    )


def early_stop(
    epochs: DataFrame,
    run: list[str] | None = None,
    score: str = "val_macro_f1",
    patience: int = K.PATIENCE,
) -> DataFrame:
    """Where training would stop, and the best epoch up to there.

    An epoch is a new best if its score beats all earlier ones. Training stops at
    the first epoch that is ``patience`` epochs past the last new best, otherwise
    at the last epoch. A window partition is one run, at most a few dozen rows.
    """
    run = run or RUN
    order = Window.partitionBy(*run).orderBy("epoch")
    earlier = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = epochs.withColumns(
        {
            "_n": F.row_number().over(order),
            "_best": F.col(score) > F.coalesce(earlier, F.lit(-1.0)),
        }
    )
    last = F.max(F.when(F.col("_best"), F.col("_n"))).over(order)
    steps = steps.withColumn("_wait", F.col("_n") - F.coalesce(last, F.lit(0)))
    stop = F.min(F.when(F.col("_wait") >= patience, F.col("epoch"))).over(
        Window.partitionBy(*run)
    )
    steps = steps.withColumn("_stop", F.coalesce(stop, F.max("epoch").over(Window.partitionBy(*run))))
    return (
        steps.filter(F.col("epoch") <= F.col("_stop"))
        .groupBy(*run)
        .agg(
            F.max(F.when(F.col("_best"), F.col("epoch"))).alias("best_epoch"),
            F.max("_stop").alias("stop_epoch"),
            (F.max("_wait") >= patience).alias("stopped_early"),
        )
    )


def latest_per_step(log: DataFrame) -> DataFrame:
    """The last entry of every step; an entry is one (ts, metrics) pair."""
    return log.groupBy("step").agg(
        F.max("ts").alias("ts"), F.max_by("metrics", "ts").alias("metrics")
    )
