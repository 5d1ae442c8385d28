"""Label maps, metadata normalisers and score bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimwright import constants as K


def binary_label(label: Column) -> Column:
    """Case-sensitive map: three labels are fake, everything else is real."""
    return F.when(label.isin(K.FAKE_LABELS), "fake").otherwise("real")


def binary_label_lenient(label: Column) -> Column:
    """Trimmed, lower-cased map that also takes labels that are already binary."""
    key = F.lower(F.trim(label))
    return F.when(key.isin(K.FAKE_LABELS + ["fake"]), "fake").otherwise("real")


def encode_label(binary: Column, unknown: int) -> Column:
    """0 for fake, 1 for real, ``unknown`` for the rest."""
    key = F.lower(binary)
    return F.when(key == "fake", 0).when(key == "real", 1).otherwise(unknown).cast("int")


def null_if_marker(value: Column) -> Column:
    """Null for the strings a CSV reader takes as missing."""
    return F.when(value.isin(K.NULL_STRINGS), None).otherwise(value)


def normal_category(value: Column) -> Column:
    return F.coalesce(F.trim(F.lower(value)), F.lit("unknown"))


def normal_category_csv(value: Column) -> Column:
    """As :func:`normal_category`, for values whose empty string means missing."""
    return normal_category(F.nullif(value, F.lit("")))


def first_subject(value: Column) -> Column:
    whole = normal_category(value)
    head = F.trim(F.element_at(F.split(whole, ","), 1))
    return F.when(whole == "", "unknown").otherwise(head)


def party_slot(party: Column) -> Column:
    """1-based slot of a party in the closed list; the last slot is ``unknown``."""
    known = F.array(*[F.lit(p) for p in K.PARTIES])
    slot = F.array_position(known, normal_category(party))
    return F.when(slot > 0, slot).otherwise(len(K.PARTIES)).cast("int")


def party_one_hot(party: Column) -> Column:
    slot = party_slot(party)
    return F.array(*[(slot == i).cast("double") for i in range(1, len(K.PARTIES) + 1)])


def score_level(score: Column) -> Column:
    """HIGH, medium or low."""
    return (
        F.when(score >= K.HIGH_SCORE, "HIGH")
        .when(score >= K.MEDIUM_SCORE, "medium")
        .otherwise("low")
    )


def score_band(score: Column) -> Column:
    """Five half-open bands from negligible to very high."""
    out = None
    for edge, name in K.SCORE_BANDS:
        out = F.when(score < edge, name) if out is None else out.when(score < edge, name)
    return out.otherwise(K.TOP_BAND)
