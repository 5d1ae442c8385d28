"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op10_exact_dedup",
    r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    WINDOW same AS (PARTITION BY norm)
    """,
)
def op10_exact_dedup(spark, sf):
    from claimwright.llm import exact_dedup

    return exact_dedup.mark_duplicates(table(spark, sf, "documents"))


_URL_PARTS = r"""
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
    FROM pages
"""


@query(
    "op4_url_filter",
    rf"""
    WITH parts AS ({_URL_PARTS}),
    rules(rule, rule_host, rule_path, says) AS (VALUES
      ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
      ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
      ('net/fr/', 'net', '/fr/', 'block')),
    named AS (
      SELECT page_id, host, path,
             CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
                  || regexp_replace(path, '(\.html)?/*$', '') END AS canonical
      FROM parts),
    listed AS (
      SELECT DISTINCT canonical FROM named
      WHERE regexp_extract(regexp_replace(host, '^(www|m|blog)\.', ''), '^([^.]*)', 1) IN
        ('ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets')),
    fits AS (
      SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
      FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY page_id)
    SELECT n.page_id, host, path, rule,
           coalesce(says, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
           CASE WHEN rule IS NULL THEN l.canonical IS NOT NULL END AS listed
    FROM named n LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON l.canonical = n.canonical
    """,
)
def op4_url_filter(spark, sf):
    from claimwright.llm import url_filter

    pages = table(spark, sf, "pages")
    return url_filter.judge_urls(pages, url_filter.listed_pages(pages))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf):
    from claimwright.llm import secrets

    found = secrets.scan_secrets(table(spark, sf, "documents"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["base"])
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


@query("op3_token_store")
def op3_token_store(spark, sf):
    import public_tokenizers

    from claimwright.llm import token_store
    from claimwright.session import scratch_uri

    store = token_store.write_store(
        table(spark, sf, "documents"), scratch_uri(spark, "token-store"), public_tokenizers.path("byte_bpe_50k.json")
    )
    read = store.read(store.directory.select("key", "rank"))
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@query("op6_language_id")
def op6_language_id(spark, sf):
    from claimwright.llm import language_id
    from claimwright.llm.common import fold

    docs = table(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    named = language_id.identify(docs, docs.where(~held_out))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores learnt from the labels outside fold 0 of 5, negatives left aside."""
    from claimwright.llm import quality
    from claimwright.llm.common import fold

    learn = fold(F.col("doc_id"), 5) != 0
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id")
    return quality.score_quality(docs, trusted, docs.where(learn).select("doc_id"))


@query("op7_quality")
def op7_quality(spark, sf):
    from claimwright.llm.common import fold

    scored = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf):
    import public_tokenizers

    from claimwright.llm import pieces

    return pieces.encode_and_decode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_toxicity")
def op2_toxicity(spark, sf):
    from claimwright.llm import toxicity
    from claimwright.llm.common import fold

    held_out = fold(F.col("doc_id"), 3) == 1
    scored = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels").where(~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op1_decontamination")
def op1_decontamination(spark, sf):
    from claimwright.llm import decontaminate

    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf):
    from claimwright.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query("op13_whitening")
def op13_whitening(spark, sf):
    from claimwright.llm import whitening

    return whitening.whiten(table(spark, sf, "embeddings"))


@query(
    "op11_ranked_search",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, terms
      FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
      WHERE len(terms) > 0),
    total AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nl FROM docs),
    held AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
    asked AS (
      SELECT item_id, term, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
    weights AS (
      SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM held, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
    scored AS (
      SELECT item_id, r, doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms)::BIGINT * nd) // nl))))::BIGINT AS score
      FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN docs USING (r), total
      GROUP BY item_id, r, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10
    """,
)
def op11_ranked_search(spark, sf):
    from claimwright.llm import ranked_search

    return ranked_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_permutation_index")
def op12_permutation_index(spark, sf):
    from claimwright.llm import permutation_index

    return permutation_index.neighbours(table(spark, sf, "embeddings"))
