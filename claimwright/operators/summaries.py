"""Corpus summaries: distributions, class weights and per-stage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimwright import constants as K
from claimwright.functions import concepts as C, labels as L, text as T


def _all_rows():
    """Frame over a whole small table: one row per class."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _share(part, whole, digits: int):
    return F.round(part / whole, digits)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage per label, largest first, ties by label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(_all_rows())  # over one row per label
    return counts.withColumn("percent", F.round(F.col("n") * 100 / total, 2)).orderBy(
        F.desc("n"), label
    )


def binary_distribution(df: DataFrame, binary: str = "binary_label") -> DataFrame:
    """Both classes in one row, 0 for an absent one."""
    fake = F.count_if(F.col(binary) == "fake")
    real = F.count_if(F.col(binary) == "real")
    n = F.count("*")
    return df.agg(
        n.alias("total_samples"),
        fake.alias("binary_fake_count"),
        real.alias("binary_real_count"),
        F.round(fake * 100 / n, 2).alias("binary_fake_percentage"),
        F.round(real * 100 / n, 2).alias("binary_real_percentage"),
    )


def class_weights(df: DataFrame, label: str = "binary_label") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per class present."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    weight = F.sum("n").over(_all_rows()) / (F.count("*").over(_all_rows()) * F.col("n"))
    return counts.withColumn("weight", weight)


def cleaning_summary(df: DataFrame, raw: str, clean: str, raw_rows=None, kept_rows=None) -> DataFrame:
    """Counters over all rows after the null filter and before duplicate removal."""
    before, after = F.col(raw), F.col(clean)
    # Links inside markup are gone before URLs and emoji are replaced, so they do not count.
    plain = T.expand_contractions(T.nfkc(T.strip_html(before)))
    aggs = [
        F.count("*").alias("rows_cleaned"),
        F.sum(T.url_count(plain)).alias("urls_replaced"),
        F.sum(T.emoji_count(plain)).alias("emojis_mapped"),
        F.sum(T.count_words(T.chunks(after), K.NEGATION_WORDS)).alias("negations_retained"),
        F.round(F.avg(T.chunk_count(before)), 2).alias("avg_len_before"),
        F.round(F.avg(T.chunk_count(after)), 2).alias("avg_len_after"),
    ]
    out = df.agg(*aggs)
    if raw_rows is not None and kept_rows is not None:
        # Includes rows dropped for nulls: raw minus final.
        out = out.withColumns(
            {
                "total_samples": F.lit(kept_rows).cast("long"),
                "duplicates_removed": F.lit(raw_rows - kept_rows).cast("long"),
            }
        )
    return out


def normalization_summary(df: DataFrame, clean: str, normal: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_samples"),
        F.sum(T.count_matches(F.col(clean), "<allcaps>")).alias("allcaps_detected"),
        F.sum(T.count_matches(F.col(clean), "<num>")).alias("numbers_normalized"),
        F.round(F.avg(T.chunk_count(F.col(clean))), 2).alias("avg_len_before"),
        F.round(F.avg(T.chunk_count(F.col(normal))), 2).alias("avg_len_after"),
    )


def token_summary(df: DataFrame, tokens: str) -> DataFrame:
    counters = T.token_counters(F.col(tokens))
    return df.agg(
        F.count("*").alias("total_samples"),
        *[F.sum(c).alias(name) for name, c in counters.items()],
        F.round(F.avg(F.size(tokens)), 2).alias("avg_tokens"),
    )


def truncation_summary(df: DataFrame, tokens: str, lengths: list[int] | None = None) -> DataFrame:
    """Per length: average before and after the cut, and how many rows it cuts.

    Only the size of each list is needed, so the lists are never copied per length.
    """
    sized = df.select(F.size(tokens).alias("n")).withColumn(
        "L", F.explode(F.array(*[F.lit(x) for x in lengths or K.SEQUENCE_LENGTHS]))
    )
    return sized.groupBy("L").agg(
        F.count("*").alias("total_samples"),
        F.round(F.avg("n"), 2).alias("original_avg_length"),
        F.round(F.avg(F.least("n", "L")), 2).alias("truncated_avg_length"),
        F.count_if(F.col("n") > F.col("L")).alias("num_truncated_samples"),
    )


def concept_summary(df: DataFrame, codes: str, by: list[str] | None = None) -> DataFrame:
    """Cue and scope counts with their shares of all tokens, optionally per group."""
    counters = C.concept_counters(F.col(codes))
    return concept_totals(df.select(*(by or []), *[c.alias(name) for name, c in counters.items()]), by)


def concept_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same of rows that hold their counters already."""
    counters = [c for c in df.columns if c.endswith("_tokens") and c not in (by or [])]
    sums = df.groupBy(*(by or [])).agg(
        F.count("*").alias("total_samples"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counters],
    )
    total = F.greatest(F.col("total_tokens"), F.lit(1))
    return sums.withColumns(
        {
            "emotion_ratio": _share(F.col("emotion_tokens"), total, 4),
            "modality_ratio": _share(
                F.col("modality_cue_tokens") + F.col("modality_scope_tokens"), total, 4
            ),
            "negation_ratio": _share(
                F.col("negation_cue_tokens") + F.col("negation_scope_tokens"), total, 4
            ),
        }
    )


def variant_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average sizes of the two evaluation variants and rows without any concept."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total_samples"),
        F.round(F.avg(F.size("sufficiency_tokens")), 2).alias("avg_sufficiency_length"),
        F.round(F.avg(F.size("comprehensiveness_tokens")), 2).alias(
            "avg_comprehensiveness_length"
        ),
        F.count_if(F.size("sufficiency_tokens") == 0).alias("samples_with_no_concepts"),
    )


def split_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, fake and real per split (and length, where ``by`` has it)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("binary_label") == "fake").alias("fake"),
        F.count_if(F.col("binary_label") == "real").alias("real"),
    )


def merge_summary(df: DataFrame, sources: tuple[str, str] = ("political", "health")) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("binary_label") == "fake").alias("fake"),
        F.count_if(F.col("binary_label") == "real").alias("real"),
        *[F.count_if(F.col("dataset_source") == s).alias(s) for s in sources],
    )


def subset_label_counts(df: DataFrame, subset: str = "subset", label: str = "label") -> DataFrame:
    """Counts per (subset, label), per subset and per label in one pass."""
    return (
        df.groupingSets([[subset, label], [subset], [label]], subset, label)
        .agg(F.count("*").alias("n"))
    )


def metadata_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.round(F.avg("has_meta"), 6).alias("coverage"))


def subword_coverage(df: DataFrame, length: int = K.SUBWORD_LENGTH) -> DataFrame:
    """Tagged sub-words per channel, share of all slots, and the low-coverage warning.

    The share divides by the slots of one channel, so a slot tagged in two
    channels counts twice.
    """
    sums = df.agg(
        F.count("*").alias("rows"),
        *[
            F.coalesce(
                F.sum(F.aggregate(c, F.lit(0), lambda a, x: a + x.cast("int"))), F.lit(0)
            ).alias(c)
            for c in K.CHANNELS
        ],
    )
    tagged = F.col("emotion") + F.col("modality") + F.col("negation")
    return sums.withColumns(
        {
            "coverage": F.round(tagged / (F.col("rows") * length), 6),
            "low_coverage": tagged < K.COVERAGE_MIN_SUBWORDS,
        }
    )


def with_binary_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("binary_label", L.binary_label(F.col(label)))
