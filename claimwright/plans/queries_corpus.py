"""Corpus building: filters, labels, duplicates, splits, summaries, merging, resampling."""

from pyspark.sql import functions as F

from claimwright import constants as K, schemas
from claimwright.functions import arrays as A, concepts as C, labels as L, text as T
from claimwright.operators import cleaning, dedup, sampling, split, summaries
from claimwright.plans import bindings as B
from claimwright.plans.registry import query
from claimwright.session import settle

_FILLED_SQL = f"""{B.CLAIMS_SQL},
filled AS (
  SELECT row_id, statement, label, coalesce(subject, 'unknown') AS subject, coalesce(speaker, 'unknown') AS speaker,
    coalesce(party, 'unknown') AS party, coalesce(context, 'unknown') AS context,
    coalesce(barely_true_count, 0) AS barely_true_count, coalesce(false_count, 0) AS false_count,
    coalesce(half_true_count, 0) AS half_true_count, coalesce(mostly_true_count, 0) AS mostly_true_count,
    coalesce(pants_fire_count, 0) AS pants_fire_count
  FROM claims WHERE statement IS NOT NULL AND label IS NOT NULL)"""

_CLEANED_SQL = f"""{_FILLED_SQL},
cleaned AS (SELECT *, {B.sql_clean_basic('statement')} AS clean_statement FROM filled),
kept AS (SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY clean_statement ORDER BY row_id) AS nth FROM cleaned) WHERE nth = 1)"""

_BINARY = "CASE WHEN label IN ('false', 'barely-true', 'pants-fire') THEN 'fake' ELSE 'real' END"
_LENIENT = "CASE WHEN lower(trim(label)) IN ('false', 'barely-true', 'pants-fire', 'fake') THEN 'fake' ELSE 'real' END"


def filled(spark, sf):
    return cleaning.fill_missing(cleaning.drop_missing(B.claims(spark, sf)))


def cleaned(spark, sf):
    return filled(spark, sf).withColumn("clean_statement", T.clean_basic(F.col("statement")))


def kept(spark, sf):
    # Stored, because the texts are looked at twice.
    return dedup.keep_first(settle(cleaned(spark, sf)), "clean_statement", ["row_id"])


# -- filters and projections --------------------------------------------------


@query("project_and_rename", "SELECT doc_id AS row_id, text AS statement, lang AS subject FROM documents")
def project_and_rename(spark, sf):
    names = {"doc_id": "row_id", "text": "statement", "lang": "subject"}
    return cleaning.project_as(B.table(spark, sf, "documents"), names)


@query(
    "drop_missing_required",
    f"WITH {B.CLAIMS_SQL} SELECT row_id, label FROM claims WHERE statement IS NOT NULL AND label IS NOT NULL",
)
def drop_missing_required(spark, sf):
    return cleaning.drop_missing(B.claims(spark, sf)).select("row_id", "label")


@query("fill_missing_values", f"WITH {_FILLED_SQL} SELECT * EXCLUDE (statement) FROM filled")
def fill_missing_values(spark, sf):
    return filled(spark, sf).drop("statement")


@query(
    "constant_columns",
    f"""WITH {B.HEADLINES_SQL} SELECT label, statement, '' AS subject, '' AS speaker, '' AS party,
      0.0::DOUBLE AS barely_true_count, 0.0::DOUBLE AS false_count, 0.0::DOUBLE AS half_true_count,
      0.0::DOUBLE AS mostly_true_count, 0.0::DOUBLE AS pants_fire_count, '' AS context,
      'health' AS dataset_source, 0 AS has_meta, label AS binary_label
    FROM headlines""",
)
def constant_columns(spark, sf):
    rows = cleaning.mark_source(cleaning.without_metadata(B.headlines(spark, sf)), "health", 0)
    return rows.select(*schemas.POLITICAL_COLUMNS, "dataset_source", "has_meta", "binary_label")


@query(
    "min_token_filter",
    f"""WITH {B.TOKENS_SQL} SELECT CAST(count(*) FILTER (n >= 300) AS BIGINT) AS kept, CAST(count(*) FILTER (n < 300) AS BIGINT) AS dropped
    FROM (SELECT len(tokens) AS n FROM docs)""",
)
def min_token_filter(spark, sf):
    # A high bound, because no document is as short as three tokens.
    docs = B.tokens(spark, sf)
    some = cleaning.min_tokens(docs, "tokens", least=300).agg(F.count("*").alias("kept"))
    everything = docs.agg(F.count("*").alias("all"))
    return some.crossJoin(everything).select("kept", (F.col("all") - F.col("kept")).alias("dropped"))


@query("metadata_row_filter", f"WITH {B.ORDER_CLAIMS_SQL} SELECT row_id, speaker FROM order_claims WHERE has_meta = 1")
def metadata_row_filter(spark, sf):
    return cleaning.metadata_rows(B.order_claims(spark, sf)).select("row_id", "speaker")


@query(
    "metadata_row_filter_fallback",
    f"WITH {B.HEADLINES_SQL} SELECT row_id, 0 AS has_meta FROM headlines",
)
def metadata_row_filter_fallback(spark, sf):
    # No row has metadata, so all rows come back.
    rows = cleaning.mark_source(B.headlines(spark, sf), "health", 0)
    return cleaning.metadata_rows(rows).select("row_id", "has_meta")


@query(
    "claim_text_fallback",
    f"WITH {_FILLED_SQL} SELECT row_id, {B.sql_clean_basic('statement')} AS claim, 1.0::DOUBLE AS has_meta FROM filled",
)
def claim_text_fallback(spark, sf):
    rows = cleaning.with_meta_flag(cleaned(spark, sf))
    return rows.select("row_id", cleaning.claim_text(rows).alias("claim"), "has_meta")


@query(
    "preview_rows",
    f"""WITH {B.CLAIMS_SQL} SELECT CASE WHEN length(statement) > 60 THEN left(statement, 60) || '...' ELSE statement END AS statement,
      label, subject FROM claims ORDER BY row_id LIMIT 3""",
)
def preview_rows(spark, sf):
    wanted = ["statement", "label", "subject", "not_there"]
    return cleaning.preview(B.claims(spark, sf), wanted, ["row_id"])


# -- labels and categories -----------------------------------------------------


@query(
    "label_maps",
    f"""WITH {B.CLAIMS_SQL} SELECT row_id, {_BINARY} AS strict, {_LENIENT} AS lenient,
      CASE lower({_LENIENT}) WHEN 'fake' THEN 0 WHEN 'real' THEN 1 ELSE 0 END AS code,
      CASE lower(label) WHEN 'fake' THEN 0 WHEN 'real' THEN 1 ELSE 0 END AS raw_as_fake,
      CASE lower(label) WHEN 'fake' THEN 0 WHEN 'real' THEN 1 ELSE 1 END AS raw_as_real
    FROM claims""",
)
def label_maps(spark, sf):
    label = F.col("label")
    return B.claims(spark, sf).select(
        "row_id",
        L.binary_label(label).alias("strict"),
        L.binary_label_lenient(label).alias("lenient"),
        L.encode_label(L.binary_label_lenient(label), unknown=0).alias("code"),
        L.encode_label(label, unknown=0).alias("raw_as_fake"),
        L.encode_label(label, unknown=1).alias("raw_as_real"),
    )


@query(
    "category_normaliser",
    f"""WITH {B.ORDER_CLAIMS_SQL} SELECT row_id, coalesce(trim(lower(speaker)), 'unknown') AS speaker,
      coalesce(trim(lower(nullif(speaker, ''))), 'unknown') AS speaker_csv,
      CASE WHEN subject IS NULL THEN 'unknown' ELSE trim(split_part(lower(subject), ',', 1)) END AS subject,
      CASE trim(lower(party)) WHEN 'republican' THEN 1 WHEN 'democrat' THEN 2 WHEN 'green' THEN 5 ELSE 7 END AS slot
    FROM order_claims""",
)
def category_normaliser(spark, sf):
    return B.order_claims(spark, sf).select(
        "row_id",
        L.normal_category(F.col("speaker")).alias("speaker"),
        L.normal_category_csv(F.col("speaker")).alias("speaker_csv"),
        L.first_subject(F.col("subject")).alias("subject"),
        L.party_slot(F.col("party")).alias("slot"),
    )


@query(
    "class_distribution",
    f"""WITH {B.CLAIMS_SQL} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent
    FROM claims WHERE label IS NOT NULL GROUP BY label""",
)
def class_distribution(spark, sf):
    return summaries.class_distribution(cleaning.drop_missing(B.claims(spark, sf)))


@query(
    "binary_distribution",
    f"""WITH {B.CLAIMS_SQL}, b AS (SELECT {_BINARY} AS x FROM claims WHERE label IS NOT NULL)
    SELECT count(*) AS total_samples, count(*) FILTER (x = 'fake') AS binary_fake_count,
      count(*) FILTER (x = 'real') AS binary_real_count,
      round(count(*) FILTER (x = 'fake') * 100.0::DOUBLE / count(*), 2) AS binary_fake_percentage,
      round(count(*) FILTER (x = 'real') * 100.0::DOUBLE / count(*), 2) AS binary_real_percentage FROM b""",
)
def binary_distribution(spark, sf):
    rows = summaries.with_binary_label(cleaning.drop_missing(B.claims(spark, sf)))
    return summaries.binary_distribution(rows)


@query(
    "class_weights",
    f"""WITH {B.CLAIMS_SQL}, b AS (SELECT {_BINARY} AS binary_label, count(*) AS n FROM claims WHERE label IS NOT NULL GROUP BY 1)
    SELECT binary_label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM b""",
)
def class_weights(spark, sf):
    rows = summaries.with_binary_label(cleaning.drop_missing(B.claims(spark, sf)))
    return summaries.class_weights(rows).withColumn("weight", F.round("weight", 6))


# -- duplicates ----------------------------------------------------------------


@query(
    "dedup_exact",
    "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
)
def dedup_exact(spark, sf):
    rows = dedup.keep_first(B.table(spark, sf, "documents"), "text", ["doc_id"])
    return rows.select("doc_id", "text")


@query("dedup_cleaned", f"WITH {_CLEANED_SQL} SELECT row_id, label, clean_statement FROM kept")
def dedup_cleaned(spark, sf):
    return kept(spark, sf).select("row_id", "label", "clean_statement")


# -- stage summaries -----------------------------------------------------------

_NEG = "('not', 'no', 'never', 'none', 'n''t')"


@query(
    "cleaning_summary",
    f"""WITH {_CLEANED_SQL}, m AS (
      SELECT regexp_extract_all(statement, '[^{B.SPACE}]+') AS b, regexp_extract_all(clean_statement, '[^{B.SPACE}]+') AS a,
        len(regexp_extract_all(statement, 'http[^{B.SPACE}]+|www[^{B.SPACE}]+')) AS u FROM cleaned)
    SELECT count(*) AS rows_cleaned, CAST(sum(u) AS BIGINT) AS urls_replaced, 0::BIGINT AS emojis_mapped,
      CAST(sum(len([x for x in a if x IN {_NEG}])) AS BIGINT) AS negations_retained,
      round(avg(len(b)), 2) AS avg_len_before, round(avg(len(a)), 2) AS avg_len_after,
      (SELECT count(*) FROM kept) AS total_samples, (SELECT count(*) FROM claims) - (SELECT count(*) FROM kept) AS duplicates_removed
    FROM m""",
)
def cleaning_summary(spark, sf):
    raw_rows = B.claims(spark, sf).count()
    rows = settle(cleaned(spark, sf).select("row_id", "statement", "clean_statement"))
    kept_rows = dedup.keep_first(rows, "clean_statement", ["row_id"]).count()
    return summaries.cleaning_summary(rows, "statement", "clean_statement", raw_rows, kept_rows)


@query(
    "normalization_summary",
    f"""WITH {_CLEANED_SQL}, m AS (SELECT clean_statement AS c, {B.sql_collapse_punct(B.sql_collapse_space('clean_statement'))} AS n FROM kept)
    SELECT count(*) AS total_samples, CAST(sum((len(c) - len(replace(c, '<allcaps>', ''))) // 9) AS BIGINT) AS allcaps_detected,
      CAST(sum((len(c) - len(replace(c, '<num>', ''))) // 5) AS BIGINT) AS numbers_normalized,
      round(avg(len(regexp_extract_all(c, '[^{B.SPACE}]+'))), 2) AS avg_len_before,
      round(avg(len(regexp_extract_all(n, '[^{B.SPACE}]+'))), 2) AS avg_len_after FROM m""",
)
def normalization_summary(spark, sf):
    rows = cleaning.normalize_political(kept(spark, sf), out="normal")
    return summaries.normalization_summary(rows, "clean_statement", "normal")


@query(
    "token_summary",
    rf"""WITH {B.TOKENS_SQL}, m AS (SELECT len(tokens) AS n,
        len([t for t in tokens if regexp_full_match(t, '[^\pL\pN]+') AND t[1] <> '<' AND NOT starts_with(t, '__')]) AS p,
        len([t for t in tokens if lower(t) IN {_NEG}]) AS g, len([t for t in tokens if regexp_full_match(t, '<[^>]+>')]) AS s FROM docs)
    SELECT count(*) AS total_samples, CAST(sum(n) AS BIGINT) AS total_tokens, CAST(sum(p) AS BIGINT) AS punctuation_tokens,
      CAST(sum(g) AS BIGINT) AS negation_tokens, CAST(sum(s) AS BIGINT) AS special_tokens, round(avg(n), 2) AS avg_tokens FROM m""",
)
def token_summary(spark, sf):
    return summaries.token_summary(B.tokens(spark, sf), "tokens")


@query(
    "truncation_summary",
    f"""WITH {B.TOKENS_SQL} SELECT CAST(l AS INT) AS L, count(*) AS total_samples, round(avg(n), 2) AS original_avg_length,
      round(avg(least(n, l)), 2) AS truncated_avg_length, count(*) FILTER (n > l) AS num_truncated_samples
    FROM (SELECT len(tokens) AS n FROM docs), (VALUES (128), (256), (512)) AS v(l) GROUP BY l""",
)
def truncation_summary(spark, sf):
    return summaries.truncation_summary(B.tokens(spark, sf), "tokens")


@query(
    "concept_summary",
    f"""WITH {B.TOKENS_SQL}, {B.sql_tagged('docs')}, s AS (
      SELECT CAST(l AS INT) AS L, count(DISTINCT row_id) AS total_samples, count(*) AS total_tokens, count(*) FILTER (cue = 'EMOTION') AS emotion_tokens,
        count(*) FILTER (cue = 'MODALITY') AS modality_cue_tokens, count(*) FILTER (reach = 'MODALITY') AS modality_scope_tokens,
        count(*) FILTER (cue = 'NEGATION') AS negation_cue_tokens, count(*) FILTER (reach = 'NEGATION') AS negation_scope_tokens
      FROM scoped, (VALUES (128), (256), (512)) AS v(l) WHERE pos < l GROUP BY l)
    SELECT *, round(emotion_tokens / total_tokens, 4) AS emotion_ratio,
      round((modality_cue_tokens + modality_scope_tokens) / total_tokens, 4) AS modality_ratio,
      round((negation_cue_tokens + negation_scope_tokens) / total_tokens, 4) AS negation_ratio FROM s""",
)
def concept_summary(spark, sf):
    # Tagged once; a tag never depends on what follows, so slices are exact.
    lengths = F.explode(F.array(*[F.lit(n) for n in K.SEQUENCE_LENGTHS]))
    codes = B.tokens(spark, sf).select(
        C.concept_codes(A.head(F.col("tokens"), max(K.SEQUENCE_LENGTHS)), B.TEST_LEXICON).alias("c")
    )
    per_length = codes.withColumn("L", lengths).withColumn("c", F.slice("c", F.lit(1), F.col("L")))
    return summaries.concept_summary(per_length, "c", by=["L"])


@query(
    "concept_rates_by_label",
    f"""WITH {_CLEANED_SQL}, docs AS (
      SELECT row_id, {_BINARY} AS binary_label, {B.sql_tokens(B.sql_collapse_punct(B.sql_collapse_space('clean_statement')))} AS tokens FROM kept),
    {B.sql_tagged('docs')}, s AS (
      SELECT binary_label, count(DISTINCT row_id) AS total_samples, count(*) AS total_tokens, count(*) FILTER (cue = 'EMOTION') AS emotion_tokens,
        count(*) FILTER (cue = 'MODALITY') AS modality_cue_tokens, count(*) FILTER (reach = 'MODALITY') AS modality_scope_tokens,
        count(*) FILTER (cue = 'NEGATION') AS negation_cue_tokens, count(*) FILTER (reach = 'NEGATION') AS negation_scope_tokens
      FROM scoped JOIN docs USING (row_id) GROUP BY binary_label)
    SELECT *, round(emotion_tokens / total_tokens, 4) AS emotion_ratio,
      round((modality_cue_tokens + modality_scope_tokens) / total_tokens, 4) AS modality_ratio,
      round((negation_cue_tokens + negation_scope_tokens) / total_tokens, 4) AS negation_ratio FROM s""",
)
def concept_rates_by_label(spark, sf):
    rows = summaries.with_binary_label(kept(spark, sf))
    normal = T.collapse_punct(T.collapse_space(F.col("clean_statement")))
    codes = rows.select(
        "binary_label",
        C.concept_codes(T.tokenize(normal), B.TEST_LEXICON).alias("codes"),
    )
    return summaries.concept_summary(codes, "codes", by=["binary_label"])


# -- split ----------------------------------------------------------------------


@query("stratified_split", f"WITH {B.ORDER_CLAIMS_SQL}, {B.sql_split('order_claims', 'binary_label, has_meta')} SELECT row_id, split FROM split_rows")
def stratified_split(spark, sf):
    rows = settle(B.order_claims(spark, sf).select("row_id", "binary_label", "has_meta"))
    return split.stratified_split(rows, ["binary_label", "has_meta"]).select("row_id", "split")


_TAGGED_SPLIT_SQL = f"""base AS (
  SELECT d.*, c.label, {_BINARY} AS binary_label FROM docs d JOIN claims c ON d.row_id = c.row_id WHERE c.label IS NOT NULL),
{B.sql_split('base', 'binary_label')}"""


def tagged_split(spark, sf):
    """Tokens, tags at the longest length, label and split of every labelled document."""
    labels = cleaning.drop_missing(B.claims(spark, sf)).select("row_id", "label")
    docs = B.tokens(spark, sf).select("row_id", "tokens").join(labels, "row_id")
    head = A.head(F.col("tokens"), max(K.SEQUENCE_LENGTHS))
    tagged = docs.withColumns(
        {
            "concept_tags": C.concept_tags(head, B.TEST_LEXICON),
            "binary_label": L.binary_label(F.col("label")),
        }
    )
    return split.stratified_split(settle(tagged), ["binary_label"])


@query(
    "split_distribution",
    f"""WITH {B.CLAIMS_SQL}, {B.TOKENS_SQL}, {_TAGGED_SPLIT_SQL}
    SELECT CAST(l AS INT) AS L, split, count(*) AS n, count(*) FILTER (binary_label = 'fake') AS fake, count(*) FILTER (binary_label = 'real') AS real
    FROM split_rows, (VALUES (128), (256), (512)) AS v(l) GROUP BY l, split""",
)
def split_distribution(spark, sf):
    tables = split.length_variants(tagged_split(spark, sf), "tokens")
    return summaries.split_distribution(tables, ["L", "split"])


@query(
    "evaluation_variants",
    f"""WITH {B.CLAIMS_SQL}, {B.TOKENS_SQL}, {_TAGGED_SPLIT_SQL}, {B.sql_tagged('split_rows')},
    lists AS (SELECT t.row_id, CAST(l AS INT) AS L,
        coalesce(string_agg(t.token, ' ' ORDER BY t.pos) FILTER (t.tag <> 'O'), '') AS sufficiency,
        coalesce(string_agg(t.token, ' ' ORDER BY t.pos) FILTER (t.tag = 'O'), '') AS comprehensiveness
      FROM tagged t, (VALUES (128), (256), (512)) AS v(l) WHERE t.pos < l GROUP BY t.row_id, l)
    SELECT lists.* FROM lists JOIN split_rows s ON lists.row_id = s.row_id WHERE s.split = 'train'""",
)
def evaluation_variants(spark, sf):
    from claimwright.plans import pipelines

    rows = pipelines.evaluation_variants(pipelines.length_tables(tagged_split(spark, sf)))
    return rows.select(
        "row_id", "L",
        F.array_join("sufficiency_tokens", " ").alias("sufficiency"),
        F.array_join("comprehensiveness_tokens", " ").alias("comprehensiveness"),
    )


@query(
    "variant_summary",
    f"""WITH {B.CLAIMS_SQL}, {B.TOKENS_SQL}, {_TAGGED_SPLIT_SQL}, {B.sql_tagged('split_rows')},
    n AS (SELECT s.row_id, CAST(l AS INT) AS L, count(*) FILTER (t.tag <> 'O' AND t.pos < l) AS a, count(*) FILTER (t.tag = 'O' AND t.pos < l) AS b
      FROM split_rows s JOIN tagged t ON s.row_id = t.row_id, (VALUES (128), (256), (512)) AS v(l) WHERE s.split = 'train' GROUP BY s.row_id, l)
    SELECT L, count(*) AS total_samples, round(avg(a), 2) AS avg_sufficiency_length, round(avg(b), 2) AS avg_comprehensiveness_length,
      count(*) FILTER (a = 0) AS samples_with_no_concepts FROM n GROUP BY L""",
)
def variant_summary(spark, sf):
    from claimwright.plans import pipelines

    rows = pipelines.evaluation_variants(pipelines.length_tables(tagged_split(spark, sf)))
    return summaries.variant_summary(rows, ["L"])


@query(
    "split_leak_check",
    f"""WITH {_CLEANED_SQL}, {B.sql_split('kept', 'label')}, parts AS (SELECT split, clean_statement FROM split_rows),
    planted AS (SELECT * FROM parts UNION ALL SELECT 'test', clean_statement FROM parts WHERE split = 'train')
    SELECT (SELECT count(*) FROM parts) AS n,
      (SELECT count(*) FROM (SELECT clean_statement FROM parts GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaks,
      (SELECT count(*) FROM (SELECT clean_statement FROM planted GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS planted_leaks""",
)
def split_leak_check(spark, sf):
    # Cleaned texts after duplicate removal, then with every train text copied into test.
    rows = settle(kept(spark, sf).select("row_id", "label", "clean_statement"))
    parts = settle(split.stratified_split(rows, ["label"]).select("split", "clean_statement"))
    copies = parts.filter(F.col("split") == "train").withColumn("split", F.lit("test"))
    leaks = split.text_leaks(parts, "clean_statement").agg(F.count("*").alias("leaks"))
    planted = split.text_leaks(parts.unionByName(copies), "clean_statement").agg(F.count("*").alias("planted_leaks"))
    return parts.agg(F.count("*").alias("n")).crossJoin(leaks).crossJoin(planted)  # one row each


# -- merge ----------------------------------------------------------------------

_MERGED_SQL = f"""{B.CLAIMS_SQL}, {B.HEADLINES_SQL},
merged AS (
  SELECT row_id * 2 AS row_id, statement, label, 'political' AS dataset_source, 1 AS has_meta, {_LENIENT} AS binary_label
  FROM claims WHERE label IS NOT NULL
  UNION ALL SELECT row_id * 2 + 1, statement, label, 'health', 0, {_LENIENT} FROM headlines)"""


def merged(spark, sf):
    def source(df, name, has_meta):
        marked = cleaning.mark_source(df, name, has_meta)
        return marked.withColumn("row_id", F.col("row_id") * 2 + (1 - has_meta))

    claims = cleaning.drop_missing(B.claims(spark, sf))
    rows, _ = cleaning.union_common(
        source(claims, "political", 1), source(B.headlines(spark, sf), "health", 0)
    )
    return rows


@query("union_shared_columns", f"WITH {_MERGED_SQL} SELECT * FROM merged")
def union_shared_columns(spark, sf):
    return merged(spark, sf)


@query(
    "merge_split_summary",
    f"""WITH {_MERGED_SQL}, {B.sql_split('merged', 'binary_label, dataset_source')}
    SELECT split, count(*) AS n, count(*) FILTER (binary_label = 'fake') AS fake, count(*) FILTER (binary_label = 'real') AS real,
      count(*) FILTER (dataset_source = 'political') AS political, count(*) FILTER (dataset_source = 'health') AS health
    FROM split_rows GROUP BY split""",
)
def merge_split_summary(spark, sf):
    rows = settle(merged(spark, sf).drop("statement"))
    parts = split.stratified_split(rows, ["binary_label", "dataset_source"])
    return summaries.merge_summary(parts)


@query(
    "metadata_coverage",
    f"""WITH {_MERGED_SQL}, {B.sql_split('merged', 'binary_label, dataset_source')}
    SELECT split, round(avg(has_meta), 6) AS coverage FROM split_rows GROUP BY split""",
)
def metadata_coverage(spark, sf):
    rows = settle(merged(spark, sf).drop("statement"))
    parts = split.stratified_split(rows, ["binary_label", "dataset_source"])
    return summaries.metadata_coverage(parts)


@query(
    "subset_label_counts",
    f"""WITH {B.HEADLINES_SQL} SELECT subset, label, count(*) AS n FROM headlines
    GROUP BY GROUPING SETS ((subset, label), (subset), (label))""",
)
def subset_label_counts(spark, sf):
    return summaries.subset_label_counts(B.headlines(spark, sf))


# -- resampling -------------------------------------------------------------------

_BUCKETS_SQL = f"""{B.ORDER_CLAIMS_SQL},
rows_in AS (SELECT row_id, has_meta, CASE binary_label WHEN 'fake' THEN 0 ELSE 1 END AS label FROM order_claims)"""


def buckets(spark, sf):
    return B.order_claims(spark, sf).select(
        "row_id", "has_meta", L.encode_label(F.col("binary_label"), unknown=0).alias("label")
    )


@query(
    "bucket_sizes",
    f"""WITH {_BUCKETS_SQL} SELECT d.domain, c.class, count(r.row_id) AS n
    FROM (VALUES (1, 'political'), (0, 'health')) AS d(f, domain) CROSS JOIN (VALUES (0, 'fake'), (1, 'real')) AS c(l, class)
      LEFT JOIN rows_in r ON r.has_meta = d.f AND r.label = c.l GROUP BY ALL""",
)
def bucket_sizes(spark, sf):
    return sampling.bucket_sizes(buckets(spark, sf))


@query(
    "balance_weights",
    f"WITH {_BUCKETS_SQL} SELECT has_meta, label, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS weight FROM rows_in GROUP BY ALL",
)
def balance_weights(spark, sf):
    weights = sampling.balance_weights(buckets(spark, sf))
    return weights.withColumn("weight", F.round("weight", 9))


@query(
    "balanced_resample",
    f"""WITH {_BUCKETS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY has_meta, label ORDER BY md5(row_id || '|42'), row_id) AS rk,
        count(*) OVER (PARTITION BY has_meta, label) AS n, count(*) OVER () AS total,
        dense_rank() OVER (ORDER BY has_meta, label) AS no FROM rows_in),
    k AS (SELECT max(no) AS k FROM ranked),
    t AS (SELECT r.*, total // k + CASE WHEN no <= total % k THEN 1 ELSE 0 END AS target FROM ranked r, k)
    SELECT row_id, has_meta, label, CAST(unnest(range(1, 1 + target // n + CASE WHEN rk <= target % n THEN 1 ELSE 0 END)) AS BIGINT) AS copy FROM t""",
)
def balanced_resample(spark, sf):
    return sampling.balanced_exact(settle(buckets(spark, sf)))


@query(
    "balanced_random_draws",
    f"""WITH {_BUCKETS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY has_meta, label ORDER BY md5(row_id || '|42-rank'), row_id) AS rk FROM rows_in),
    sizes AS (SELECT *, row_number() OVER (ORDER BY has_meta, label) - 1 AS no FROM (SELECT has_meta, label, count(*) AS n FROM rows_in GROUP BY ALL)),
    draws AS (SELECT row_id AS draw, CAST('0x' || substr(md5(row_id || '|42-bucket'), 1, 13) AS HUGEINT) * (SELECT count(*) FROM sizes) // 4503599627370496 AS no,
      CAST('0x' || substr(md5(row_id || '|42-row'), 1, 13) AS HUGEINT) AS u FROM rows_in)
    SELECT d.draw, r.row_id, r.has_meta, r.label FROM draws d JOIN sizes s ON d.no = s.no
      JOIN ranked r ON r.has_meta = s.has_meta AND r.label = s.label AND r.rk = 1 + d.u * s.n // 4503599627370496""",
)
def balanced_random_draws(spark, sf):
    return sampling.balanced_draws(settle(buckets(spark, sf)))
