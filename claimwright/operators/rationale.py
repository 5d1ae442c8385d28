"""Readable rationales from concept scores and attention weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright import constants as K
from claimwright.functions import labels as L, maths as M
from claimwright.functions.arrays import let

CHANNEL_ORDER = (("emotion", "em"), ("modality", "mo"), ("negation", "ne"))
TITLES = {"emotion": "Emotion", "modality": "Modality", "negation": "Negation"}


def channel_text(channel: str, score: Column) -> Column:
    """Template sentence of a channel at the score's level."""
    level = L.score_level(score)
    text = K.CHANNEL_TEXT[channel]
    return (
        F.when(level == "HIGH", text["HIGH"])
        .when(level == "medium", text["medium"])
        .otherwise(text["low"])
    )


def score_line(number: int, channel: str, score: Column) -> Column:
    lead = f"Step {number} [{TITLES[channel]}]:".ljust(20)
    return F.concat(
        F.lit(lead),
        F.format_string("score %.2f → %-6s  — ", score, L.score_level(score)),
        channel_text(channel, score),
    )


def verdict(pred: Column) -> Column:
    return F.when(pred == 0, "FAKE").otherwise("REAL")


def summary_sentence(em: Column, mo: Column, ne: Column, pred: Column) -> Column:
    """Names the channels at HIGH level, or says that none stands out."""

    def driver(channel, score):
        return F.when(L.score_level(score) == "HIGH", K.DRIVER_TEXT[channel])

    drivers = F.concat_ws(
        " and ", driver("emotion", em), driver("negation", ne), driver("modality", mo)
    )
    fake, some = pred == 0, drivers != ""
    return (
        F.when(some & fake, F.format_string(K.SUMMARY_TEXT["drivers_fake"], drivers))
        .when(some, F.format_string(K.SUMMARY_TEXT["drivers_real"], drivers))
        .when(fake, K.SUMMARY_TEXT["none_fake"])
        .otherwise(K.SUMMARY_TEXT["none_real"])
    )


def _verdict_lines(pred: Column, conf: Column) -> list[Column]:
    return [
        F.concat(F.lit("Verdict:     "), verdict(pred)),
        F.format_string("Confidence:  %.1f%%", conf * 100),
    ]


def rationale_text(em: Column, mo: Column, ne: Column, logit0: Column, logit1: Column) -> Column:
    """Score lines, verdict, confidence and summary of one prediction."""
    pred = M.predicted_class(logit0, logit1)
    rule = F.lit("─" * 45)
    scores = {"em": em, "mo": mo, "ne": ne}
    lines = [
        score_line(i, channel, scores[short])
        for i, (channel, short) in enumerate(CHANNEL_ORDER, 1)
    ]
    reasoning = F.concat(F.lit("Reasoning: "), summary_sentence(em, mo, ne, pred))
    return F.concat_ws(
        "\n", *lines, rule, *_verdict_lines(pred, M.confidence(logit0, logit1)), rule, reasoning
    )


def top_subwords(alpha: Column, pieces: Column, real: Column, mask: Column, k: int = 5) -> Column:
    """Best ``k`` sub-words by weight among real, tagged slots that are not special marks.

    Ties go to the earlier slot. The row's arrays are sorted in place, no shuffle.
    """
    special = ["[CLS]", "[SEP]", "[PAD]", "[UNK]"]
    kept = F.filter(
        F.arrays_zip(alpha.alias("a"), pieces.alias("p"), real.alias("r"), mask.alias("m")),
        lambda z: (-z["a"] < 0) & (z["r"] > 0) & (z["m"] > 0) & ~z["p"].isin(special),
    )
    # What is kept keeps its order, so its numbers settle ties as the slots would.
    ranked = F.transform(kept, lambda z, i: F.struct((-z["a"]).alias("w"), i.alias("i"), z["p"].alias("p")))
    best = F.slice(F.sort_array(ranked), 1, k)
    return F.transform(
        best,
        lambda z: F.struct(
            F.regexp_replace(z["p"], "^##", "").alias("token"), (-z["w"]).alias("weight")
        ),
    )


def format_top_tokens(pairs: Column) -> Column:
    def text(found: Column) -> Column:
        lines = F.transform(found, lambda z: F.format_string('"%s" (α=%.2f)', z["token"], z["weight"]))
        return F.when(F.size(found) == 0, K.NO_TOKENS_TEXT).otherwise(F.array_join(lines, ", "))

    return let(pairs, text)


def rationale_with_tokens(
    statement: Column, scores: dict[str, Column], tops: dict[str, Column], logit0: Column, logit1: Column
) -> Column:
    """Rationale that cites the sub-words each channel attended to."""
    rule = F.lit("─" * 72)
    lines = []
    for i, (channel, short) in enumerate(CHANNEL_ORDER, 1):
        lines.append(score_line(i, channel, scores[short]))
        lines.append(F.concat(F.lit("            Top tokens: "), format_top_tokens(tops[short])))
    pred = M.predicted_class(logit0, logit1)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Statement: "), statement),
        rule,
        *lines,
        rule,
        *_verdict_lines(pred, M.confidence(logit0, logit1)),
    )


def sample_rationales(df: DataFrame, text: str, key: str = "row_id", n: int = 10) -> DataFrame:
    """The first ``n`` rationales in key order, numbered."""
    first = df.orderBy(key).limit(n)
    return first.withColumn("example", F.row_number().over(Window.orderBy(key))).select(
        "example", F.concat(F.format_string("--- example %d ---\n", "example"), text, F.lit("\n")).alias("block")
    )


# -- long form --------------------------------------------------------------


def top_words_long(
    df: DataFrame, group: list[str], k: int = 4, placeholders: list[str] | None = None
) -> DataFrame:
    """Best ``k`` distinct words per group from ``(group, word, alpha, real)`` rows.

    Rows that are padding, have no weight or hold a placeholder are left out; a
    word that fills several slots keeps its best weight.
    """
    placeholders = placeholders or K.PLACEHOLDER_WORDS
    word = F.trim("word")
    usable = df.filter(
        (F.col("real") > 0) & (F.col("alpha") > 0) & (word != "") & ~word.isin(placeholders)
    )
    best = usable.groupBy(*group, word.alias("word")).agg(F.max("alpha").alias("alpha"))
    order = Window.partitionBy(*group).orderBy(F.desc("alpha"), "word")
    return best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
