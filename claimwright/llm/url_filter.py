"""URL filter: prefix rules first, then a list of canonical URLs.

The list is probed through a blocked Bloom filter. Most URLs are certainly not listed
and never move; only possible hits are shuffled to an exact hash join with the list,
which removes the false ones. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.llm import bloom
from claimwright.llm.common import salted

ALLOW, BLOCK = "allow", "block"
SALTS = 8

#: The rules (host and path prefix) and their verdicts.
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)

#: First labels of the sites whose pages make up the block list.
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or a URL without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without ``.html`` and closing slashes.

    Scheme, query and fragment are left out. Null for an empty host.
    """
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html)?/*$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rest = text.partition("/")
        own = (host == rule_host) | host.endswith("." + rule_host)
        fits = own & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    blocks: int = 1 << 14,
) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, listed``.

    ``listed`` has canonical URLs in column ``canonical``; repeats and nulls do no harm.
    A page without a fitting rule is blocked if its canonical URL is listed, else
    allowed; ``listed`` is null where a rule decided. Null ids and repeated rows pass
    through; a null or malformed URL has empty host and path and is allowed. Other
    columns of ``pages`` are not read. An empty list blocks nothing.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "verdict": says, "canonical": canonical(F.col("host"), F.col("path"))})
    by_rule = ruled.where(F.col("rule").isNotNull()).withColumn("listed", F.lit(None).cast("boolean"))
    names = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    probed = bloom.maybe_listed(
        ruled.where(F.col("rule").isNull()), "canonical", bloom.build(names, "canonical", blocks), blocks
    )
    misses = probed.where(~F.col("__maybe")).withColumn("listed", F.lit(False))
    # One URL may be a third of all rows: its rows are dealt out over the salts.
    possible = probed.where("__maybe").withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    exact = salted(names.withColumn("listed", F.lit(True)), SALTS).hint("shuffle_hash")
    hits = possible.join(exact, ["canonical", "__salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    columns = ["__id", "host", "path", "rule", "verdict", "listed"]
    rows = by_rule.select(columns).unionByName(misses.select(columns)).unionByName(hits.select(columns))
    by_list = F.when(F.col("listed"), BLOCK).otherwise(ALLOW)
    return rows.select(
        F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict"), "listed"
    )


def listed_pages(pages: DataFrame, url_col: str = "url", sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """Canonical URLs of the pages of the listed sites, with repeats."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    first = F.regexp_extract(F.regexp_replace(host, r"^(www|m|blog)\.", ""), r"^([^.]*)", 1)
    return pages.where(first.isin(*sites)).select(canonical(host, path).alias("canonical"))
