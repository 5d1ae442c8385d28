"""Connected components of an edge table, by alternating large and small stars.

Each round hangs every vertex on a smaller one among its neighbours; in the end all
vertices of a component point to its smallest. Rounds are written tables, so a lost
executor costs one round's tasks. Minima are partial aggregates and nothing is
collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright.session import settle


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex of ``edges`` (bigint columns ``u``, ``v``).

    ``root`` is the smallest vertex of the component. Loops, repeats and either order of
    a pair do no harm; null ends are left out; no edges give no vertices.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    real = edges.where("u is not null and v is not null and u <> v")
    now = settle(real.select(u, v).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return stars.unionAll(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
