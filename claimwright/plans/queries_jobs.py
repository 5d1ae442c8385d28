"""End-to-end jobs on the test tables."""

from pyspark.sql import functions as F

from claimwright.functions import arrays as A
from claimwright.operators import metrics, model, runs, summaries
from claimwright.plans import bindings as B, pipelines
from claimwright.plans.queries_corpus import _BINARY, _CLEANED_SQL, _LENIENT
from claimwright.plans.registry import query
from claimwright.session import settle

# -- corpora -----------------------------------------------------------------------------

_POLITICAL_SQL = f"""{_CLEANED_SQL},
political0 AS (SELECT row_id, label, clean_statement, {_BINARY} AS binary_label,
    {B.sql_tokens(B.sql_collapse_punct(B.sql_collapse_space('clean_statement')))} AS tokens FROM kept)"""

_HEALTH_SQL = f"""{B.HEADLINES_SQL},
h1 AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY row_id) AS nth FROM headlines) WHERE nth = 1),
h2 AS (SELECT *, {B.sql_trim_space(B.sql_clean_basic(B.sql_strip_prefix('statement')))} AS clean_statement FROM h1),
h3 AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY clean_statement ORDER BY row_id) AS nth FROM h2) WHERE nth = 1),
health0 AS (SELECT row_id, label, subset, clean_statement, {B.sql_tokens(B.sql_collapse_space('clean_statement'))}[1:128] AS tokens FROM h3),
health AS (SELECT * FROM health0 WHERE len(tokens) >= 3)"""


@query(
    "political_corpus",
    f"""WITH {_POLITICAL_SQL}, heads AS (SELECT row_id, tokens[1:512] AS tokens FROM political0), {B.sql_tagged('heads')},
    lists AS (SELECT row_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tagged GROUP BY row_id), {B.sql_split('political0', 'binary_label')}
    SELECT s.row_id, s.split, s.binary_label, s.clean_statement, l.tags FROM split_rows s JOIN lists l ON s.row_id = l.row_id""",
)
def political_corpus(spark, sf):
    rows = pipelines.political_corpus(B.claims(spark, sf), B.TEST_LEXICON)
    return rows.select(
        "row_id", "split", "binary_label", "clean_statement",
        F.array_join("concept_tags", " ").alias("tags"),
    )


@query(
    "health_corpus",
    f"""WITH {_HEALTH_SQL}, {B.sql_tagged('health')},
    lists AS (SELECT row_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tagged GROUP BY row_id)
    SELECT h.row_id, h.subset, h.label AS binary_label, h.clean_statement, '' AS speaker, 0.0::DOUBLE AS false_count, l.tags
    FROM health h JOIN lists l ON h.row_id = l.row_id""",
)
def health_corpus(spark, sf):
    rows = pipelines.health_corpus(B.headlines(spark, sf), B.TEST_LEXICON)
    return rows.select(
        "row_id", "subset", "binary_label", "clean_statement", "speaker", "false_count",
        F.array_join("concept_tags", " ").alias("tags"),
    )


#: The length ``L`` of the merged corpus: the trained variant of both sources.
MERGED_LENGTH = 128


def merged(spark, sf):
    tagged = pipelines.tag_claims(
        pipelines.clean_claims(B.claims(spark, sf)), B.TEST_LEXICON, length=MERGED_LENGTH
    ).withColumn("split", F.lit(None).cast("string"))
    # The trained variant has its tokens and tags at one length: whole texts are stored once, cleaned.
    tagged = tagged.drop("statement", "normalized_text", "tokens")
    health = pipelines.health_corpus(B.headlines(spark, sf), B.TEST_LEXICON)
    return pipelines.merged_corpus(tagged, health)


@query(
    "merged_corpus",
    f"""WITH {_POLITICAL_SQL}, {_HEALTH_SQL}, merged0 AS (
      SELECT row_id * 2 AS row_id, 'political' AS dataset_source, 1 AS has_meta, {_LENIENT} AS binary_label, len(tokens[1:128]) AS n FROM political0
      UNION ALL SELECT row_id * 2 + 1, 'health', 0, label, len(tokens) FROM health),
    {B.sql_split('merged0', 'binary_label, dataset_source').replace('(rk, n)', '(rk, total)').replace('AS n FROM', 'AS total FROM').replace('(n *', '(total *')}
    SELECT row_id, split, dataset_source, has_meta, binary_label, 128 AS L, CAST(n AS INT) AS n FROM split_rows""",
)
def merged_corpus(spark, sf):
    return merged(spark, sf).select(
        "row_id", "split", "dataset_source", "has_meta", "binary_label",
        F.lit(MERGED_LENGTH).alias("L"), F.size("truncated_tokens").alias("n"),
    )


@query(
    "encoded_splits",
    f"""WITH {_POLITICAL_SQL}, {B.sql_split('political0', 'binary_label')},
    words AS (SELECT row_id, split, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM split_rows),
    vocab AS (SELECT token, CAST(1 + row_number() OVER (ORDER BY cnt DESC, r, p) AS INT) AS idx FROM (
      SELECT token, count(*) AS cnt, min(row_id) AS r, arg_min(pos, row_id * 1000000 + pos) AS p FROM words WHERE split = 'train' GROUP BY token HAVING count(*) >= 2)),
    ids AS (SELECT w.row_id, string_agg(CAST(coalesce(v.idx, 1) AS VARCHAR), ' ' ORDER BY pos) AS x, count(*) AS n
      FROM words w LEFT JOIN vocab v ON w.token = v.token WHERE pos < 128 GROUP BY w.row_id)
    SELECT s.row_id, s.split, s.label, s.binary_label, x || repeat(' 0', CAST(128 - n AS INT)) AS indices FROM split_rows s JOIN ids ON s.row_id = ids.row_id""",
)
def encoded_splits(spark, sf):
    # Its rows are stored already, and the split is two comparisons a row.
    corpus = pipelines.political_corpus(
        B.claims(spark, sf), B.TEST_LEXICON, columns=["label", "tokens", "concept_tags"]
    )
    _, ids = pipelines.encode_splits(corpus, "tokens", 128)
    return ids.select(
        "row_id", "split", "label", "binary_label", F.array_join("indices", " ").alias("indices")
    )


@query(
    "merged_concept_coverage",
    f"""WITH {_POLITICAL_SQL}, {_HEALTH_SQL}, merged0 AS (
      SELECT row_id * 2 AS row_id, tokens[1:128] AS tokens FROM political0 UNION ALL SELECT row_id * 2 + 1, tokens FROM health),
    {B.sql_tagged('merged0')},
    pieces AS (SELECT row_id, pos, tag, unnest(range(CAST(ceil(greatest(length(token), 1) / 4) AS INT))) AS piece FROM tagged),
    slots AS (SELECT tag, row_number() OVER (PARTITION BY row_id ORDER BY pos, piece) AS slot FROM pieces),
    s AS (SELECT (SELECT count(*) FROM merged0) AS rows, count(*) FILTER (tag = 'EMOTION') AS emotion,
        count(*) FILTER (tag IN ('MODALITY', 'MODALITY_SCOPE')) AS modality, count(*) FILTER (tag IN ('NEGATION', 'NEGATION_SCOPE')) AS negation
      FROM slots WHERE slot <= 126)
    SELECT *, round((emotion + modality + negation) / (rows * 128.0::DOUBLE), 6) AS coverage, emotion + modality + negation < 1000 AS low_coverage FROM s""",
)
def merged_concept_coverage(spark, sf):
    return summaries.subword_coverage(pipelines.concept_features(merged(spark, sf)))


# -- encoder and classifier ----------------------------------------------------------------


@query("encoded_slots")
def encoded_slots(spark, sf):
    docs = B.tokens(spark, sf).select("row_id", "tokens")
    rows = model.encode_slots(docs, model.hashed_projection(16), "tokens")
    return rows.groupBy("row_id").agg(
        F.count("*").alias("slots"),
        F.countDistinct("word").alias("n_words"),
        F.round(F.sum(F.col("vec")[0].cast("double")), 4).alias("first_dim"),
    )


def trained(spark, sf):
    corpus = settle(merged(spark, sf))
    return pipelines.train_and_score(corpus, grid=(0.01, 0.1))


@query("classifier_scores")
def classifier_scores(spark, sf):
    _, _, scored = trained(spark, sf)
    return scored.select("row_id", "label", "has_meta", "logit0", "logit1", "pred", "conf", "em", "mo", "ne")


@query("classifier_report")
def classifier_report(spark, sf):
    _, val_score, scored = trained(spark, sf)
    scored = settle(scored)
    return pipelines.result_record(
        scored, val_score, tag="merged_L128", phase=3, dataset="merged", L=128, use_meta=True, seed=42
    )


@query("training_runs")
def training_runs(spark, sf):
    # Three seeds with and without metadata, fitted in the same passes and summed up per setting.
    table = pipelines.training_table(settle(merged(spark, sf)))
    settings = [(seed, use_meta) for use_meta in (True, False) for seed in (41, 42, 43)]
    test = table.filter(F.col("split") == "test").drop("clean_statement", "concept_tags")
    records = None
    for (seed, use_meta), (fitted, score) in zip(settings, pipelines.train_runs(table, settings, grid=(0.1,))):
        tag = "merged_meta" if use_meta else "merged_text"
        one = pipelines.result_record(settle(model.score_rows(fitted, test)), score, tag=tag, seed=seed, use_meta=use_meta)
        records = one if records is None else records.unionByName(one)
    return runs.seed_summary(records)


@query("faithfulness")
def faithfulness(spark, sf):
    table = pipelines.training_table(settle(merged(spark, sf)))
    fitted, _, _ = pipelines.train_and_score(table, grid=(0.1,), table=table)
    return model.faithfulness(fitted, table.filter(F.col("split") == "test"))


@query("classifier_cards")
def classifier_cards(spark, sf):
    fitted, _, scored = trained(spark, sf)
    return pipelines.curated_cards(settle(scored), fitted=fitted)
