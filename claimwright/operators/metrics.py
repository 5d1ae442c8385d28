"""Quality metrics and losses over a prediction table.

Every classification metric is derived from the confusion counts: one aggregate
over the predictions, then arithmetic on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright import constants as K
from claimwright.functions import maths as M


def domain_of(flag):
    return F.when(flag == 1, "political").otherwise("health")


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"))


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "label", "pred").agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class seen in labels or predictions.

    A ratio with a zero denominator is 0.
    """
    by = by or []
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"), F.col("n").alias("support"),
            zero.alias("predicted"), hit.alias("tp"),
        ),
        F.struct(
            F.col("pred").alias("cls"), zero.alias("support"),
            F.col("n").alias("predicted"), zero.alias("tp"),
        ),
    )
    sums = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    # 2PR / (P + R) written on the counts, which needs no second zero rule.
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return sums.select(
        *by, "cls", "support", "predicted", "tp",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def classification_report(df: DataFrame, names=((0, "fake"), (1, "real"))) -> DataFrame:
    """Rows per class plus accuracy, macro and weighted averages, four decimals."""
    scores = class_scores(confusion(df))
    name = F.create_map(*[F.lit(x) for pair in names for x in pair])
    measures = ("precision", "recall", "f1")
    classes = scores.select(
        F.element_at(name, F.col("cls")).alias("row"), *measures, "support"
    )
    weighted = [
        (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures
    ]
    hits = F.sum("tp") / F.sum("support")
    totals = scores.agg(
        F.struct(*[F.avg(m).alias(m) for m in measures]).alias("macro"),
        F.struct(*weighted).alias("weighted"),
        hits.alias("hits"),
        F.sum("support").alias("support"),
    )
    averages = totals.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("accuracy").alias("row"),
                    *[F.col("hits").alias(m) for m in measures],
                    F.col("support"),
                ),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("row"),
                        *[F.col(f"{kind}.{m}").alias(m) for m in measures],
                        F.col("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        )
    )
    both = classes.unionByName(averages)
    return both.select("row", *[F.round(m, 4).alias(m) for m in measures], "support")


def macro_f1(df: DataFrame) -> DataFrame:
    """Unweighted mean F1 over the classes in labels or predictions."""
    return class_scores(confusion(df)).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def domain_report(df: DataFrame) -> DataFrame:
    """Rows, accuracy and macro-F1 overall and per domain; absent domains are left out."""
    cells = confusion(df.withColumn("domain", domain_of(F.col("has_meta"))), ["domain"])
    cells = cells.select(
        F.explode(F.array("domain", F.lit("overall"))).alias("domain"), "label", "pred", "n"
    )
    cells = cells.groupBy("domain", "label", "pred").agg(F.sum("n").alias("n"))
    return (
        class_scores(cells, ["domain"])
        .groupBy("domain")
        .agg(
            F.sum("support").alias("n"),
            F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
            F.round(F.avg("f1"), 6).alias("macro_f1"),
        )
    )


def channel_means(df: DataFrame) -> DataFrame:
    return df.agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("em", "mo", "ne")])


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``class_weight`` = n / (k * n_c), by one aggregate over the two labels."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    present = (n0 > 0).cast("int") + (n1 > 0).cast("int")
    weights = df.agg(
        (F.count("*") / (present * F.nullif(n0, F.lit(0)))).alias("_w0"),
        (F.count("*") / (present * F.nullif(n1, F.lit(0)))).alias("_w1"),
    )
    return (
        df.crossJoin(F.broadcast(weights))  # one row
        .withColumn("class_weight", F.when(F.col(label) == 1, F.col("_w1")).otherwise(F.col("_w0")))
        .drop("_w0", "_w1")
    )


def weighted_losses(df: DataFrame, smoothing: float = K.SMOOTHING, gamma: float = K.FOCAL_GAMMA) -> DataFrame:
    """Smoothed cross-entropy and focal loss: class-weighted, plain means."""
    args = F.col("logit0"), F.col("logit1"), F.col("label")
    weighted = with_class_weight(df)
    return weighted.agg(
        F.round(
            F.avg(F.col("class_weight") * M.smoothed_cross_entropy(*args, smoothing)), 6
        ).alias("smoothed_ce"),
        F.round(F.avg(M.focal_loss(*args, F.col("class_weight"), gamma)), 6).alias("focal"),
    )


def _gated(channel: str, present: str):
    """Cross-entropy of a channel's own logits over rows that hold the concept."""
    ce = M.cross_entropy(F.col(f"{channel}_logit0"), F.col(f"{channel}_logit1"), F.col("label"))
    w = F.when(F.col(present) > 0, F.col("class_weight"))
    return F.coalesce(F.sum(w * ce) / F.sum(w), F.lit(0.0))


def _coverage(score: str, present: str, target: float):
    """How far the mean score of rows with the concept stays below the target."""
    mean = F.avg(F.when(F.col(present) > 0, F.col(score)))
    return F.coalesce(F.greatest(F.lit(target) - mean, F.lit(0.0)), F.lit(0.0))


def objective(
    df: DataFrame,
    by: list[str] | None = None,
    aux_weight: float = K.AUX_WEIGHT,
    coverage_weight: float = K.COVERAGE_WEIGHT,
    target: float = K.COVERAGE_TARGET,
) -> DataFrame:
    """Main, auxiliary, coverage and combined loss per group, in one aggregate.

    Expects ``logit0, logit1, label``, the class weight, and per channel the
    score, its own two logits and a presence flag.
    """
    args = F.col("logit0"), F.col("logit1"), F.col("label")
    channels = ("em", "mo", "ne")
    main = F.avg(F.col("class_weight") * M.smoothed_cross_entropy(*args))
    aux = sum((_gated(c, f"{c}_present") for c in channels[1:]), _gated("em", "em_present"))
    cov = sum(
        (_coverage(c, f"{c}_present", target) for c in channels[1:]),
        _coverage("em", "em_present", target),
    )
    sums = df.groupBy(*(by or [])).agg(
        main.alias("main_loss"), aux.alias("aux_loss"), cov.alias("cov_loss")
    )
    total = (
        F.col("main_loss") + aux_weight * F.col("aux_loss") + coverage_weight * F.col("cov_loss")
    )
    return sums.select(
        *(by or []),
        *[F.round(c, 6).alias(c) for c in ("main_loss", "aux_loss", "cov_loss")],
        F.round(total, 6).alias("train_loss"),
    )
