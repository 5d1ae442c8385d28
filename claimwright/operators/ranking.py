"""Exact ranks and exact cut positions without a one-task sort.

A plain ``row_number`` over a few large strata puts each stratum on one task.
Rows are ordered by a hash instead, and the hash prefix cuts every stratum into
ordered buckets. Counting rows per bucket gives each bucket's offset, so only
rows inside a bucket have to be sorted, and to find a cut position only one
bucket per cut is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright.session import has_at_most, settle

MAX_STRATA = 10_000


def hash_order(key: Column, seed) -> Column:
    """Pseudo-random but portable order: hex MD5 of ``key|seed``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def _bucketed(df: DataFrame, key: str, seed, digits: int) -> DataFrame:
    order = hash_order(F.col(key), seed)
    return df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, digits))


def bucketed_rank(
    df: DataFrame, strata: list[str], key: str, seed, out: str = "rank", digits: int = 4
) -> DataFrame:
    """Rank of every row in its stratum, ordered by ``(hash, key)``, from 1.

    ``digits`` hex digits give ``16 ** digits`` buckets per stratum; whole rows
    move here, so there are more of them than for cuts.
    """
    rows = _bucketed(df, key, seed, digits)
    sizes = rows.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*strata)
        .orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    return (
        rows.join(offsets.drop("_n"), [*strata, "_b"])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_h", "_b", "_before")
    )


def stratum_cuts(
    df: DataFrame, strata: list[str], key: str, seed, positions: dict[str, Column], digits: int = 3
) -> DataFrame:
    """For each stratum, the ``(hash, key)`` of the row at each named position.

    ``positions`` are expressions over ``n`` (rows in the stratum), ``total``
    (rows overall), ``strata_count`` and ``stratum_no`` (from 1, in key order).
    Position 0 yields a null cut. The result has one row per stratum, with a
    struct column per cut, and is broadcast if it is small. Only keys and strata
    are read, and 4,096 buckets per stratum keep the one that is sorted small.
    """
    rows = _bucketed(df.select(*strata, key), key, seed, digits)
    sizes = settle(rows.groupBy(*strata, "_b").agg(F.count("*").alias("_n")))
    # One row per stratum from here on, so a window over all of them is tiny.
    per_stratum = sizes.groupBy(*strata).agg(F.sum("_n").alias("n"))
    few = has_at_most(per_stratum, MAX_STRATA)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_stratum = per_stratum.withColumns(
        {
            "total": F.sum("n").over(everything),
            "strata_count": F.count("*").over(everything),
            "stratum_no": F.row_number().over(Window.orderBy(*strata)),
        }
    ).withColumns({f"_p_{name}": p.cast("long") for name, p in positions.items()})

    earlier = (
        Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    wanted = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(per_stratum, strata)
        .withColumn(
            "_cut",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("name"), F.col(f"_p_{name}").alias("at"))
                        for name in positions
                    ]
                )
            ),
        )
        .filter(
            (F.col("_cut.at") > F.col("_before"))
            & (F.col("_cut.at") <= F.col("_before") + F.col("_n"))
        )
        .select(*strata, "_b", "_before", "_cut")
    )
    if few:  # one row per stratum and cut
        wanted = F.broadcast(wanted)
    inside = Window.partitionBy(*strata, "_b", F.col("_cut.name")).orderBy("_h", key)
    found = (
        rows.join(wanted, [*strata, "_b"])
        .withColumn("_at", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_at") == F.col("_cut.at"))
        .groupBy(*strata)
        .agg(
            *[
                F.max(
                    F.when(
                        F.col("_cut.name") == name,
                        F.struct(F.col("_h").alias("h"), F.col(key).alias("k")),
                    )
                ).alias(name)
                for name in positions
            ]
        )
    )
    facts = per_stratum.select(*strata, "n", "total", "strata_count", "stratum_no")
    cuts = settle(facts.join(found, strata, "left"))
    return F.broadcast(cuts) if few else cuts


def at_or_before(cut: str, key: str, seed) -> Column:
    """Whether a row's ``(hash, key)`` is not after a cut; false for a null cut."""
    mine = F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    return F.coalesce(mine <= F.col(cut), F.lit(False))


def frequency_rank(counts: DataFrame, value: str, out: str = "rank", slices: int = 1024) -> DataFrame:
    """Rank values by ``cnt`` descending, ties by ``first`` ascending, from 1.

    Buckets follow the order itself: steps of a log scale for counts from 1,024,
    the exact count and the position range of ``first`` below. Most values of a
    large vocabulary share a small count, and the ranges are what splits those up.
    The offsets table holds at most a few million rows whatever the data size.
    """
    span = counts.agg(F.min("first").alias("_lo"), F.max("first").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / slices + 1
    rows = counts.crossJoin(F.broadcast(span)).withColumns(  # one row
        {
            "_c": F.when(F.col("cnt") < 1024, F.col("cnt")).otherwise(
                1024 + F.floor(64 * F.log2(F.col("cnt") / 1024))
            ),
            # A log step mixes counts, so it must not be cut by position.
            "_f": F.when(
                F.col("cnt") < 1024, F.floor((F.col("first") - F.col("_lo")) / width)
            )
            .otherwise(0)
            .cast("int"),
        }
    )
    sizes = rows.groupBy("_c", "_f").agg(F.count("*").alias("_n"))
    in_level = (
        Window.partitionBy("_c").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    )
    levels = sizes.groupBy("_c").agg(F.sum("_n").alias("_level"))
    above = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_above", F.coalesce(F.sum("_level").over(above), F.lit(0)))
    offsets = (
        sizes.withColumn("_left", F.coalesce(F.sum("_n").over(in_level), F.lit(0)))
        .join(levels, "_c")
        .select("_c", "_f", (F.col("_left") + F.col("_above")).alias("_before"))
    )
    inside = Window.partitionBy("_c", "_f").orderBy(F.desc("cnt"), "first", value)
    return (
        rows.join(offsets, ["_c", "_f"])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_lo", "_hi", "_c", "_f", "_before")
    )
