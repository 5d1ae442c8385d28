"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded(ids: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows of ``ids`` (column ``__id``, other columns ride along), chosen by hash of the id."""
    return ids.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(rows)


def with_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, match: dict[str, str] | None = None) -> DataFrame:
    """``picked`` with ``__text``, one row for each row of ``picked`` that has a text.

    Broadcast, since the sample's bound is a parameter. Where an id is repeated its smallest
    text is taken, nulls last. ``match`` names further columns of ``picked`` and ``docs`` that must agree.
    """
    also = match or {}
    texts = docs.select(
        F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__of{k}") for k, c in enumerate(also.values()))
    )
    on = F.col("__doc") == F.col("__id")
    for k, name in enumerate(also):
        on = on & (F.col(f"__of{k}") == F.col(name))
    return texts.join(F.broadcast(picked), on).groupBy(*picked.columns).agg(F.min("__text").alias("__text"))
