"""Batch encoding, a weighted classifier, batch scoring, attribution and faithfulness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright import constants as K
from claimwright.functions import arrays as A, maths as M
from claimwright.operators import linear
from claimwright.operators.metrics import class_scores, confusion, with_class_weight
from claimwright.session import broadcast_if_small
from claimwright.sources import versions


def hashed_projection(dim: int = 64) -> Callable:
    """Deterministic stand-in encoder: every word gets a fixed pseudo-random vector.

    Returns a loader, called once per task, that gives the function from a list
    of sentences (lists of words) to one float matrix per sentence.
    """

    def load():
        import hashlib
        from functools import lru_cache

        import numpy as np

        @lru_cache(maxsize=50_000)
        def vector(word: str):
            seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            return np.random.default_rng(seed).standard_normal(dim).astype("float32")

        def encode(sentences):
            return [np.array([vector(w) for w in words]).reshape(-1, dim) for words in sentences]

        return encode

    return load


def encode_slots(
    df: DataFrame,
    loader: Callable,
    tokens: str,
    key: str = "row_id",
    length: int = K.SUBWORD_LENGTH,
    batch_rows: int = 256,
) -> DataFrame:
    """Long feature table ``(row_id, slot, word, vec)``, one row per filled slot.

    Alignment is computed in the JVM; Python only turns words into vectors, a
    bounded number of sentences at a time. The encoder is loaded once per task.
    Long form leaves out padding, which a dense tensor would store.
    """
    slots = df.select(
        key,
        A.head(F.col(tokens), length).alias("words"),
        A.subword_slots(F.col(tokens), length).alias("slots"),
    )

    def run(batches):
        import numpy as np
        import pandas as pd

        encode = loader()

        def table(rows):
            word_of = [np.asarray(s) for s in rows["slots"]]
            used = [np.flatnonzero(w >= 0) for w in word_of]
            picked = [w[u] for w, u in zip(word_of, used)]
            texts = [[str(words[i]) for i in p] for words, p in zip(rows["words"], picked)]
            vectors = encode(texts)
            return pd.DataFrame(
                {
                    key: np.repeat(rows[key].to_numpy(), [len(u) for u in used]),
                    "slot": np.concatenate(used),
                    "word": np.concatenate(picked),
                    # An object column, also when there is no vector at all.
                    "vec": pd.Series([v for matrix in vectors for v in matrix], dtype=object),
                }
            )

        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield table(batch.iloc[start : start + batch_rows])

    kind = dict(df.dtypes)[key]
    return slots.mapInPandas(run, f"{key} {kind}, slot int, word int, vec array<float>")


def macro_f1_values(predictions: DataFrame, models: int) -> list[float]:
    """Macro-F1 of each model from ``margins``: one confusion count for all of them."""
    long = predictions.select("label", F.posexplode("margins").alias("model", "z"))
    cells = confusion(long.select("model", "label", (F.col("z") > 0).cast("int").alias("pred")), ["model"])
    rows = class_scores(cells, ["model"]).groupBy("model").agg(F.avg("f1").alias("f1")).collect()
    of = {r["model"]: r["f1"] for r in rows}
    return [of.get(k) or 0.0 for k in range(models)]


def fit_best(
    train: DataFrame,
    val: DataFrame,
    runs: dict[str, tuple[str, bool]],
    tokens: str = "truncated_tokens",
    meta: str | None = "meta",
    grid: tuple = (0.001, 0.01, 0.1),
    most_words: int = linear.MOST_WORDS,
) -> dict[str, tuple[linear.Models, float]]:
    """For each run the model of the grid value with the best val macro-F1, and that score.

    ``runs`` names each run's weight column and whether it sees metadata. All runs and grid
    values are fitted and scored in the same passes (:mod:`claimwright.operators.linear`).
    """
    settings = [linear.Setting(name, reg, weight, use_meta) for name, (weight, use_meta) in runs.items() for reg in grid]
    models = linear.fit_models(train, settings, tokens, meta, most_words)
    scores = macro_f1_values(linear.margins(models, val, tokens, meta).select("label", "margins"), len(settings))
    best = {}
    for k, setting in enumerate(settings):
        if setting.name not in best or scores[k] > best[setting.name][1]:
            best[setting.name] = (models.pick(k), scores[k])
    return best


def fit_classifier(
    train: DataFrame,
    val: DataFrame,
    tokens: str = "truncated_tokens",
    meta: str | None = "meta",
    grid: tuple = (0.001, 0.01, 0.1),
    most_words: int = linear.MOST_WORDS,
) -> tuple[linear.Models, float]:
    """Class-weighted logistic regression; the grid value with the best val macro-F1 wins.

    Text features are word counts over the ``most_words`` words that occur in most train
    rows; ``meta=None`` leaves the metadata out. Features are made once and every
    pass, which serves all grid values, reads them from a stored table.
    """
    weighed = with_class_weight(train)
    return fit_best(weighed, val, {"": ("class_weight", meta is not None)}, tokens, meta, grid, most_words)[""]


def score_rows(
    model: linear.Models, df: DataFrame, tokens: str = "truncated_tokens", meta: str | None = "meta"
) -> DataFrame:
    """Add logits, prediction and confidence; rows stay in their partitions."""
    scored = linear.margins(model, df, tokens, meta)
    return linear.with_verdict(scored, F.col("margins")[0]).drop("margins")


def save_classifier(model: linear.Models, path: str) -> None:
    """Make the best model the current version at ``path``; an older one stays until then."""
    spark = SparkSession.getActiveSession()
    dims = len(model.coefficients) - len(model.words)
    names = pa.array([*model.words, *[None] * dims], pa.string())
    rows = pa.table({"no": np.arange(len(names)), "word": names, "coefficient": model.coefficients[:, 0]})
    (setting,) = model.settings
    note = {"intercept": float(model.intercepts[0]), "setting": asdict(setting)}
    versions.replace(spark.createDataFrame(rows), path, note=note)


def load_classifier(path: str) -> linear.Models:
    spark = SparkSession.getActiveSession()
    version = versions.current(spark, path)
    rows = versions.read(spark, path, version.number).orderBy("no").toArrow()
    words = [w for w in rows.column("word").to_pylist() if w is not None]
    coefficients = rows.column("coefficient").to_numpy()[:, None]
    return linear.Models(words, coefficients, np.array([version.note["intercept"]]), (linear.Setting(**version.note["setting"]),))


def attributions(model: linear.Models, rows: DataFrame, tokens: str = "truncated_tokens", key: str = "row_id", pred: str = "pred") -> DataFrame:
    """What each word adds to the log odds of the predicted class: ``(key, pos, word, adds)``.

    A word counts once each time it occurs, so a row's words sum up to its log odds
    without metadata and intercept. Words that the model doesn't know add 0.
    """
    known = broadcast_if_small(linear.coefficient_table(rows.sparkSession, model), linear.MOST_WORDS)
    long = rows.select(key, F.col(pred).alias("_pred"), F.posexplode(tokens).alias("pos", "word")).join(known, "word", "left")
    sign = F.when(F.col("_pred") == 1, 1.0).otherwise(-1.0)
    return long.select(key, "pos", "word", (sign * F.coalesce("coefficient", F.lit(0.0))).alias("adds"))


def channel_scores(tags: str) -> dict:
    """Share of a row's words per channel, standing in for trained head scores."""
    n = F.greatest(F.size(tags), F.lit(1))
    short = {"emotion": "em", "modality": "mo", "negation": "ne"}
    return {
        short[c]: A.mask_total(A.channel_mask(F.col(tags), c)) / n for c in K.CHANNELS
    }


def faithfulness(
    model: linear.Models, df: DataFrame, tokens: str = "truncated_tokens", tags: str = "concept_tags", meta: str | None = "meta"
) -> DataFrame:
    """Average probability of the full-text prediction under three token variants.

    Sufficiency keeps only concept tokens, comprehensiveness only the others.
    """
    df = df.select("row_id", tokens, tags, *([] if meta is None else [meta, "has_meta"]))
    full = score_rows(model, df, tokens, meta).select(
        "row_id", F.col("pred").alias("_pred"), F.col("conf").alias("_full")
    )
    both = F.col(tokens), F.col(tags)
    lists = {
        "sufficiency": A.keep_concept_tokens(*both),
        "comprehensiveness": A.drop_concept_tokens(*both),
    }
    variants = F.array(
        *[F.struct(F.lit(name).alias("variant"), c.alias("t")) for name, c in lists.items()]
    )
    long = df.withColumn("_v", F.explode(variants)).withColumns(
        {"variant": F.col("_v.variant"), tokens: F.col("_v.t")}
    ).drop("_v")
    scored = score_rows(model, long, tokens, meta).join(full, "row_id")
    prob = F.exp(M.log_prob(F.col("logit0"), F.col("logit1"), F.col("_pred")))
    return scored.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.avg("_full").alias("full"),
        F.avg(prob).alias("variant_prob"),
        F.avg(F.col("_full") - prob).alias("drop"),
        F.avg((F.col("pred") == F.col("_pred")).cast("int")).alias("same_verdict"),
    )
