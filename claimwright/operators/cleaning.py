"""Row filters, projections and schema-aware fallbacks on claim tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimwright import constants as K
from claimwright.functions import labels as L, text as T


def project_as(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the mapped columns only, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_missing(df: DataFrame, columns: tuple = ("statement", "label")) -> DataFrame:
    """Drop rows without the required fields."""
    return require_columns(df, list(columns)).na.drop(subset=list(columns))


def fill_missing(df: DataFrame) -> DataFrame:
    """``unknown`` for text metadata, 0 for credit counts."""
    texts = {c: "unknown" for c in K.TEXT_META_COLUMNS if c in df.columns}
    counts = [c for c in K.CREDIT_COLUMNS if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("double") for c in counts})
    return df.na.fill(texts).na.fill(0.0, subset=counts)


def without_metadata(df: DataFrame) -> DataFrame:
    """Empty text metadata and zero counts for a corpus that has none."""
    return df.withColumns(
        {
            **{c: F.lit("") for c in K.TEXT_META_COLUMNS},
            **{c: F.lit(0.0) for c in K.CREDIT_COLUMNS},
        }
    )


def mark_source(df: DataFrame, source: str, has_meta: int) -> DataFrame:
    """Source name, metadata flag and a freshly computed binary label."""
    return df.withColumns(
        {
            "dataset_source": F.lit(source),
            "has_meta": F.lit(has_meta).cast("int"),
            "binary_label": L.binary_label_lenient(F.col("label")),
        }
    )


def min_tokens(df: DataFrame, tokens: str = "truncated_tokens", least: int = K.MIN_TOKENS) -> DataFrame:
    return df.filter(F.size(tokens) >= least)


def metadata_rows(df: DataFrame) -> DataFrame:
    """Rows with ``has_meta = 1``; every row if there is none, or no such column."""
    if "has_meta" not in df.columns:
        return df
    seen = df.agg(
        F.coalesce(F.max((F.col("has_meta") == 1).cast("int")), F.lit(0)).alias("_seen")
    )
    return (
        df.crossJoin(F.broadcast(seen))  # one row
        .filter((F.col("has_meta") == 1) | (F.col("_seen") == 0))
        .drop("_seen")
    )


def claim_text(df: DataFrame) -> Column:
    """``clean_statement`` where the table has it, else ``statement``; null becomes empty."""
    name = "clean_statement" if "clean_statement" in df.columns else "statement"
    return F.coalesce(F.col(name), F.lit(""))


def with_meta_flag(df: DataFrame) -> DataFrame:
    """``has_meta`` as a number, 1.0 everywhere if the table lacks it."""
    flag = F.col("has_meta").cast("double") if "has_meta" in df.columns else F.lit(1.0)
    return df.withColumn("has_meta", flag)


def preview(df: DataFrame, wanted: list[str], order: list[str], rows: int = 3, width: int = 60) -> DataFrame:
    """First rows in key order, available columns only, long text clipped."""
    columns = [c for c in wanted if c in df.columns] or df.columns[:4]
    kinds = dict(df.dtypes)

    def show(name: str) -> Column:
        c = F.col(name)
        if kinds[name] != "string":
            return c
        clipped = F.concat(F.left(c, F.lit(width)), F.lit("..."))
        return F.when(F.length(c) > width, clipped).otherwise(c).alias(name)

    return df.orderBy(*order).limit(rows).select(*[show(c) for c in columns])


def union_common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Union on the shared columns, and the columns each side leaves out."""
    common = [c for c in a.columns if c in b.columns]
    left_out = {
        "first": sorted(set(a.columns) - set(common)),
        "second": sorted(set(b.columns) - set(common)),
    }
    return a.select(*common).unionByName(b.select(*common)), left_out


# -- text profiles ------------------------------------------------------------
#
# The steps that may leave the JVM look at their input more than once ("does the
# row need this, and if not keep it"). They are chained column by column, so that
# each result is computed once instead of being copied into the next expression.


def _chain(df: DataFrame, source: str, out: str, steps: list) -> DataFrame:
    value = F.col(source)
    for step in steps:
        df = df.withColumn("_text", step(value))
        value = F.col("_text")
    return df.withColumn(out, value).drop("_text")


def clean_political(
    df: DataFrame, source: str = "statement", out: str = "clean_statement", exact_html: bool = True
) -> DataFrame:
    """Markup, NFKC, contractions, URLs, emoji, capitals, numbers, marks, case."""
    return _chain(
        df,
        source,
        out,
        [
            T.html_to_text if exact_html else T.strip_html,
            T.nfkc,
            T.expand_contractions,
            T.mask_urls,
            T.name_emojis,
            lambda c: F.lower(T.collapse_marks(T.mask_numbers(T.mark_allcaps(c)))),
        ],
    )


def clean_health(
    df: DataFrame, source: str = "statement", out: str = "clean_statement"
) -> DataFrame:
    """Verdict prefixes out, then the steps every profile shares, trimmed; JVM only."""
    return df.withColumn(
        out, T.trim_space(T.clean_basic(T.strip_verdict_prefix(F.col(source))))
    )


def normalize_political(
    df: DataFrame, source: str = "clean_statement", out: str = "normalized_text"
) -> DataFrame:
    """NFKC, contractions, one blank for white space, runs of punctuation."""
    return _chain(
        df,
        source,
        out,
        [T.nfkc, T.expand_contractions, lambda c: T.collapse_punct(T.collapse_space(c))],
    )


def normalize_health(
    df: DataFrame, source: str = "clean_statement", out: str = "normalized_text"
) -> DataFrame:
    """As the political profile, but runs of punctuation stay."""
    return _chain(df, source, out, [T.nfkc, T.expand_contractions, T.collapse_space])
