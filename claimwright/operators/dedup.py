"""Keep-first duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright.session import has_at_most, settle

#: Rows to leave out that are sent to every task, about 100 MB there.
MAX_GONE = 2_000_000


def keep_first(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per distinct ``text``: the first in ``order``, which must be unique.

    The first place of each text is a narrow aggregate over a 128-bit hash, with map-side
    partials, so a text that makes up a third of the corpus costs its reducer one small
    row per map task. Places that are not first are then taken out by their unique order: no
    text is sorted or compared, and no key is hot. Up to ``MAX_GONE`` of them are broadcast, so
    that whole rows stay where they are; more than that are met in a shuffle.
    """
    hashes = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]
    # Stored, since it is looked at twice and the texts are not to be hashed again.
    keys = settle(df.select(*hashes, *[F.col(c).alias(f"_at_{c}") for c in order]))
    firsts = (
        keys.groupBy("_h1", "_h2")
        .agg(F.min(F.struct(*[f"_at_{c}" for c in order])).alias("_first"))
        .select(*[F.col(f"_first._at_{c}").alias(f"_first_{c}") for c in order])
    )
    first, same = F.lit(True), F.lit(True)
    for c in order:
        first = first & F.col(f"_at_{c}").eqNullSafe(F.col(f"_first_{c}"))
        same = same & df[c].eqNullSafe(F.col(f"_at_{c}"))
    gone = keys.drop("_h1", "_h2").join(firsts, first, "left_anti")
    return df.join(F.broadcast(gone) if has_at_most(gone, MAX_GONE) else gone, same, "left_anti")
