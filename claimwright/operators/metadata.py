"""Metadata features: fit vocabularies and scaler on train, encode any split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from claimwright import constants as K
from claimwright.functions import labels as L
from claimwright.operators.cleaning import metadata_rows
from claimwright.session import settle

FIELDS = ["speaker", "subject", "context"]


def _category(field: str, csv_nulls: bool):
    source = F.col(field)
    if csv_nulls:
        source = F.nullif(source, F.lit(""))
    return L.first_subject(source) if field == "subject" else L.normal_category(source)


def fit_vocabs(train: DataFrame, key: str = "row_id", top_k: dict | None = None, csv_nulls: bool = False) -> DataFrame:
    """``(field, value, cnt, idx)`` for the three category fields.

    One pass counts the values of all fields; the few best of each are then
    taken with a top-k, so no task ever sorts the values of a whole field.
    """
    top_k = top_k or K.TOP_K
    long = metadata_rows(train).select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), _category(f, csv_nulls).alias("value"))
                    for f in FIELDS
                ]
            )
        ),
    )
    counts = settle(
        long.groupBy("field", "value").agg(F.count("*").alias("cnt"), F.min(key).alias("first"))
    )
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "first"))
    parts = [
        counts.filter(F.col("field") == f)
        .orderBy(F.desc("cnt"), "first")
        .limit(top_k[f])
        .select("field", "value", "cnt", rank.alias("idx"))
        for f in FIELDS
    ]
    return reduce(DataFrame.unionByName, parts)


def fit_scaler(train: DataFrame) -> DataFrame:
    """One row: mean and population deviation (at least 1e-6) of each count."""
    aggs = []
    for c in K.CREDIT_COLUMNS:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [
            F.avg(x).alias(f"mu_{c}"),
            F.greatest(F.stddev_pop(x), F.lit(1e-6)).alias(f"sd_{c}"),
        ]
    return metadata_rows(train).agg(*aggs)


def vocab_sizes(vocabs: DataFrame) -> DataFrame:
    """Slots per field; every size includes the unknown slot."""
    return vocabs.groupBy("field").agg((F.count("*") + 1).alias("size"))


def encode_metadata(
    df: DataFrame,
    vocabs: DataFrame,
    scaler: DataFrame,
    key: str = "row_id",
    csv_nulls: bool = False,
    extra: list[str] | None = None,
) -> DataFrame:
    """15 slots per row: party one-hot (7), scaled counts (5), three category ids.

    The vocabularies hold at most ``top_k`` rows each and the scaler one, so the
    joins are broadcasts and the rows are not shuffled.
    """
    out = df.withColumns({f"_{f}": _category(f, csv_nulls) for f in FIELDS})
    for f in FIELDS:
        words = vocabs.filter(F.col("field") == f).select(
            F.col("value").alias(f"_{f}"), F.col("idx").alias(f"{f}_idx")
        )
        out = out.join(F.broadcast(words), f"_{f}", "left")
    out = out.crossJoin(F.broadcast(scaler))  # one row
    scaled = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")
        for c in K.CREDIT_COLUMNS
    ]
    ids = [F.coalesce(F.col(f"{f}_idx"), F.lit(0)).cast("double") for f in FIELDS]
    features = F.concat(L.party_one_hot(F.col("party")), F.array(*scaled), F.array(*ids))
    return out.select(key, *(extra or []), features.alias("meta"))
