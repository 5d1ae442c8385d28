"""Curated example cards: filter, spread over domains and classes, write up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright import constants as K
from claimwright.functions import labels as L
from claimwright.session import settle

BUCKET_ORDER = (("political", 0), ("political", 1), ("health", 0), ("health", 1))


def good_examples(
    df: DataFrame,
    min_confidence: float = K.MIN_CONFIDENCE,
    min_score: float = K.MIN_CONCEPT_SCORE,
) -> DataFrame:
    """Correct, confident and with at least one substantive concept score."""
    return df.filter(
        (F.col("pred") == F.col("label"))
        & (F.col("conf") >= min_confidence)
        & (F.greatest("em", "mo", "ne") >= min_score)
    )


def round_robin(df: DataFrame, n: int = 8, key: str = "row_id") -> DataFrame:
    """``n`` rows taken in turn from the (domain, class) buckets, best score first.

    No bucket can give more than ``n`` rows. Keys and scores alone are sorted to find
    theirs; texts are read for the rows of these few keys, which are then ranked again.
    """
    domain = F.when(F.col("has_meta") == 1, "political").otherwise("health")
    turn = F.coalesce(
        *[
            F.when((F.col("domain") == d) & (F.col("label") == c), F.lit(i))
            for i, (d, c) in enumerate(BUCKET_ORDER)
        ]
    )
    best = Window.partitionBy("domain", "label").orderBy(
        F.desc(F.greatest("em", "mo", "ne")), key
    )
    marked = df.withColumn("domain", domain)
    narrow = marked.select(key, "domain", "label", "em", "mo", "ne").withColumn("_round", F.row_number().over(best))
    keys = settle(narrow.filter(F.col("_round") <= n).select(F.col(key).alias("_key")).distinct())
    picked = (
        marked.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("_key")), "left_semi")  # n keys a bucket
        .withColumn("_round", F.row_number().over(best))
        .filter(F.col("_round") <= n)
        .withColumn("_turn", turn)
        .orderBy("_round", "_turn")
        .limit(n)
    )
    return picked.withColumn(
        "example", F.row_number().over(Window.orderBy("_round", "_turn"))
    ).drop("_round", "_turn")


def drivers(em: Column, mo: Column, ne: Column) -> Column:
    """Phrases of the channels at or above the limit, strongest first, ties in channel order."""

    def entry(channel, score, order):
        return F.when(
            score >= K.SUMMARY_MIN_SCORE,
            F.struct(
                (-score).alias("s"), F.lit(order).alias("o"),
                F.lit(K.SUMMARY_PHRASES[channel]).alias("p"),
            ),
        )

    found = F.array_compact(
        F.array(entry("emotion", em, 0), entry("modality", mo, 1), entry("negation", ne, 2))
    )
    return F.transform(F.array_sort(found), lambda z: z["p"])


def human_summary(em: Column, mo: Column, ne: Column, pred: Column, conf: Column) -> Column:
    """One sentence: what drove the verdict, the verdict and its confidence."""
    names = drivers(em, mo, ne)
    n = F.size(names)
    listed = F.concat(
        F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
        F.lit(" and "),
        F.get(names, n - 1),
    )
    body = (
        F.when(n == 0, K.SUMMARY_NONE)
        .when(n == 1, F.concat(F.lit("primarily by the "), F.get(names, F.lit(0)), F.lit(" the model attended to")))
        .otherwise(F.concat(F.lit("by "), listed))
    )
    label = F.when(pred == 0, "FAKE").otherwise("REAL")
    return F.format_string("Verdict driven %s. → predicted %s (confidence %.2f).", body, label, conf)


def format_words(pairs: Column) -> Column:
    """``"word" (0.31)`` items, or a dash when there is none."""
    text = F.array_join(
        F.transform(pairs, lambda z: F.format_string('"%s" (%.2f)', z["word"], z["alpha"])), ", "
    )
    return F.when(F.size(pairs) == 0, "—").otherwise(text)


def card_text(tops: dict[str, Column]) -> Column:
    """Card of one chosen row; ``tops`` are its formatted word lists by channel."""
    name = F.create_map(F.lit(0), F.lit("fake"), F.lit(1), F.lit("real"))
    rule = "─" * 71
    steps = []
    for i, (title, short) in enumerate((("EMOTION", "em"), ("MODALITY", "mo"), ("NEGATION", "ne")), 1):
        lead = f"  Step {i} — {title} channel".ljust(29)
        steps.append(
            F.format_string(f"{lead}(score=%.2f, %s)", F.col(short), L.score_band(F.col(short)))
        )
        steps.append(F.concat(F.lit("           top tokens: "), tops[short]))
        steps.append(F.lit(""))
    title = F.format_string(
        "EXAMPLE %d  (%s · gold=%s · pred=%s · conf=%.2f)",
        F.col("example"), F.upper("domain"), name[F.col("label")], name[F.col("pred")], F.col("conf"),
    )
    summary = human_summary(
        F.col("em"), F.col("mo"), F.col("ne"), F.col("pred"), F.col("conf")
    )
    return F.concat_ws(
        "\n",
        F.lit(rule), title, F.lit(rule),
        F.lit("Claim:"), F.concat(F.lit('  "'), F.col("claim"), F.lit('"')), F.lit(""),
        F.lit("Reasoning trace:"), *steps,
        F.lit("  Conclusion:"), F.concat(F.lit("    "), summary), F.lit(""),
    )
