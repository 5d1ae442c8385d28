"""Vocabularies, metadata features, alignment, masks, attention and pooling."""

from pyspark.sql import functions as F

from claimwright import constants as K
from claimwright.functions import arrays as A, concepts as C, labels as L
from claimwright.operators import align, metadata, pooling, split, summaries, vocab
from claimwright.plans import bindings as B
from claimwright.plans.registry import query
from claimwright.session import scratch_path, settle
from claimwright.sources import versions

# -- vocabularies -----------------------------------------------------------------


@query(
    "token_frequency",
    f"WITH {B.TOKENS_SQL} SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM docs) GROUP BY token",
)
def token_frequency(spark, sf):
    return vocab.token_counts(B.tokens(spark, sf), "tokens").select("token", "cnt")


_WORDS_SQL = """words AS (
  SELECT row_id, split, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM split_rows),
vocab AS (
  SELECT token, cnt, CAST(1 + row_number() OVER (ORDER BY cnt DESC, r, p) AS INT) AS idx FROM (
    SELECT token, count(*) AS cnt, min(row_id) AS r, arg_min(pos, row_id * 1000000 + pos) AS p
    FROM words WHERE split = 'train' GROUP BY token HAVING count(*) >= 2))"""


def split_tokens(spark, sf):
    """Token lists with a split, stratified by language."""
    docs = settle(B.tokens(spark, sf).select("row_id", "lang", "tokens"))
    return split.stratified_split(docs, ["lang"])


def train_vocab(rows):
    return settle(vocab.fit_token_vocab(rows.filter(F.col("split") == "train"), "tokens"))


@query(
    "token_vocabulary",
    f"WITH {B.TOKENS_SQL}, {B.sql_split('docs', 'lang')}, {_WORDS_SQL} SELECT * FROM vocab",
)
def token_vocabulary(spark, sf):
    return train_vocab(split_tokens(spark, sf))


@query(
    "vocabulary_parameters",
    f"""WITH {B.TOKENS_SQL}, {B.sql_split('docs', 'lang')}, {_WORDS_SQL}
    SELECT 'vocab_size' AS key, CAST(count(*) + 2 AS VARCHAR) AS value FROM vocab
    UNION ALL VALUES ('min_freq', '2'), ('pad_token', '[PAD]'), ('unk_token', '[UNK]')""",
)
def vocabulary_parameters(spark, sf):
    return vocab.vocab_params(train_vocab(split_tokens(spark, sf)))


@query(
    "encode_tokens",
    f"""WITH {B.TOKENS_SQL}, {B.sql_split('docs', 'lang')}, {_WORDS_SQL},
    ids AS (SELECT row_id, split, pos, coalesce(v.idx, 1) AS idx FROM words w LEFT JOIN vocab v ON w.token = v.token),
    lists AS (SELECT row_id, split, CAST(l AS INT) AS L, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) FILTER (pos < l) AS x,
      count(*) FILTER (pos < l) AS n FROM ids, (VALUES (128), (256), (512)) AS v(l) GROUP BY row_id, split, l)
    SELECT row_id, split, L, x || repeat(' 0', CAST(L - n AS INT)) AS indices FROM lists""",
)
def encode_tokens(spark, sf):
    rows = split_tokens(spark, sf)
    words = train_vocab(rows)
    # Encoded once at the longest length; a shorter one is its head.
    longest = max(K.SEQUENCE_LENGTHS)
    ids = vocab.encode_tokens(rows, words, "tokens", longest, hot=1000)
    parts = ids.join(rows.select("row_id", "split"), "row_id")
    return parts.withColumn(
        "L", F.explode(F.array(*[F.lit(n) for n in K.SEQUENCE_LENGTHS]))
    ).select(
        "row_id", "split", "L",
        F.array_join(F.slice("indices", F.lit(1), F.col("L")), " ").alias("indices"),
    )


_SMALL = {"the": 2, "of": 3, "de": 4, "und": 5, "y": 6}


@query(
    "encode_small_vocabulary",
    f"""WITH {B.TOKENS_SQL}, words AS (SELECT row_id, len(tokens) AS n, unnest(tokens[1:128]) AS token, unnest(range(len(tokens[1:128]))) AS pos FROM docs)
    SELECT row_id, string_agg(CASE token WHEN 'the' THEN '2' WHEN 'of' THEN '3' WHEN 'de' THEN '4' WHEN 'und' THEN '5' WHEN 'y' THEN '6' ELSE '1' END, ' ' ORDER BY pos)
      || repeat(' 0', CAST(128 - count(*) AS INT)) AS indices FROM words GROUP BY row_id""",
)
def encode_small_vocabulary(spark, sf):
    ids = vocab.encode_inline(F.col("tokens"), _SMALL, 128)
    return B.tokens(spark, sf).select("row_id", F.array_join(ids, " ").alias("indices"))


@query(
    "top_speakers",
    f"""WITH {B.ORDER_CLAIMS_SQL}, c AS (SELECT coalesce(trim(lower(speaker)), 'unknown') AS value, count(*) AS cnt, min(row_id) AS f
      FROM order_claims WHERE has_meta = 1 GROUP BY 1)
    SELECT value, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, f) AS INT) AS idx FROM c QUALIFY idx <= 500""",
)
def top_speakers(spark, sf):
    rows = B.order_claims(spark, sf).filter(F.col("has_meta") == 1)
    rows = rows.select("row_id", L.normal_category(F.col("speaker")).alias("speaker"))
    return vocab.top_values(rows, "speaker", "row_id", 500)


# -- metadata -----------------------------------------------------------------------

_CREDIT = K.CREDIT_COLUMNS

_META_SQL = f"""{B.ORDER_CLAIMS_SQL}, {B.sql_split('order_claims', 'binary_label')},
fit AS (SELECT *, coalesce(trim(lower(nullif(speaker, ''))), 'unknown') AS s1,
    CASE WHEN nullif(subject, '') IS NULL THEN 'unknown' ELSE trim(split_part(lower(subject), ',', 1)) END AS s2,
    coalesce(trim(lower(nullif(context, ''))), 'unknown') AS s3 FROM split_rows),
train AS (SELECT * FROM fit WHERE split = 'train' AND has_meta = 1),
long AS (SELECT row_id, 'speaker' AS field, s1 AS value FROM train UNION ALL SELECT row_id, 'subject', s2 FROM train
  UNION ALL SELECT row_id, 'context', s3 FROM train),
vocabs AS (SELECT field, value, cnt, CAST(rk AS INT) AS idx FROM (
  SELECT field, value, cnt, row_number() OVER (PARTITION BY field ORDER BY cnt DESC, f) AS rk FROM (
    SELECT field, value, count(*) AS cnt, min(row_id) AS f FROM long GROUP BY ALL))
  WHERE rk <= CASE field WHEN 'speaker' THEN 500 WHEN 'subject' THEN 100 ELSE 80 END),
scaler AS (SELECT {', '.join(f"avg(coalesce({c}, 0)) AS mu_{c}, greatest(stddev_pop(coalesce({c}, 0)), 1e-6) AS sd_{c}" for c in _CREDIT)} FROM train)"""


def meta_parts(spark, sf):
    """Split order claims with vocabularies and scaler fitted on train."""
    rows = settle(B.order_claims(spark, sf))
    rows = settle(split.stratified_split(rows, ["binary_label"]))
    train = rows.filter(F.col("split") == "train")
    vocabs = settle(metadata.fit_vocabs(train, csv_nulls=True))
    return rows, vocabs, settle(metadata.fit_scaler(train))


@query("metadata_vocabularies", f"WITH {_META_SQL} SELECT * FROM vocabs")
def metadata_vocabularies(spark, sf):
    return meta_parts(spark, sf)[1]


@query(
    "metadata_scaler",
    f"WITH {_META_SQL} SELECT {', '.join(f'round(mu_{c}, 6) AS mu_{c}, round(sd_{c}, 6) AS sd_{c}' for c in _CREDIT)} FROM scaler",
)
def metadata_scaler(spark, sf):
    scaler = meta_parts(spark, sf)[2]
    return scaler.select(*[F.round(c, 6).alias(c) for c in scaler.columns])


@query("metadata_vocab_sizes", f"WITH {_META_SQL} SELECT field, count(*) + 1 AS size FROM vocabs GROUP BY field")
def metadata_vocab_sizes(spark, sf):
    return metadata.vocab_sizes(meta_parts(spark, sf)[1])


_SLOTS = [
    *[f"CASE WHEN slot = {i} THEN 1.0 ELSE 0.0 END" for i in range(1, 8)],
    *[f"(coalesce(f.{c}, 0) - mu_{c}) / sd_{c}" for c in _CREDIT],
    *[f"coalesce(v{i}.idx, 0)" for i in (1, 2, 3)],
]
_FEATURES_SQL = f"""WITH {_META_SQL},
slots AS (SELECT *, CASE trim(lower(party)) WHEN 'republican' THEN 1 WHEN 'democrat' THEN 2 WHEN 'green' THEN 5 ELSE 7 END AS slot FROM fit)
SELECT f.row_id, f.split, {', '.join(f'round(CAST({s} AS DOUBLE) * GATE, 6) + 0 AS m{i}' for i, s in enumerate(_SLOTS))}
FROM slots f CROSS JOIN scaler LEFT JOIN vocabs v1 ON v1.field = 'speaker' AND v1.value = f.s1
  LEFT JOIN vocabs v2 ON v2.field = 'subject' AND v2.value = f.s2 LEFT JOIN vocabs v3 ON v3.field = 'context' AND v3.value = f.s3"""


@query("metadata_features", _FEATURES_SQL.replace("GATE", "1"))
def metadata_features(spark, sf):
    rows, vocabs, scaler = meta_parts(spark, sf)
    out = metadata.encode_metadata(rows, vocabs, scaler, csv_nulls=True, extra=["split"])
    slots = [(F.round(F.col("meta")[i], 6) + 0.0).alias(f"m{i}") for i in range(15)]
    return out.select("row_id", "split", *slots)


@query("metadata_gate", _FEATURES_SQL.replace("GATE", "f.has_meta"))
def metadata_gate(spark, sf):
    rows, vocabs, scaler = meta_parts(spark, sf)
    out = metadata.encode_metadata(rows, vocabs, scaler, csv_nulls=True, extra=["split", "has_meta"])
    gated = out.withColumn("meta", A.gate(F.col("meta"), F.col("has_meta")))
    slots = [(F.round(F.col("meta")[i], 6) + 0.0).alias(f"m{i}") for i in range(15)]
    return gated.select("row_id", "split", *slots)


# -- truncation, variants, masks ------------------------------------------------------


def tagged(spark, sf, length=None):
    """Words and tags of whole texts, or of the first ``length`` words for fixed-width slots."""
    words = F.col("tokens") if length is None else A.head(F.col("tokens"), length)
    docs = B.tokens(spark, sf).select("row_id", words.alias("words"))
    return docs.withColumn("tags", C.concept_tags(F.col("words"), B.TEST_LEXICON))


_WHOLE_SQL = f"""{B.TOKENS_SQL}, {B.sql_tagged('docs')}"""
_HEAD_SQL = f"""{B.TOKENS_SQL}, heads AS (SELECT row_id, tokens[1:128] AS tokens FROM docs), {B.sql_tagged('heads')}"""


@query(
    "head_truncation",
    f"""WITH {B.TOKENS_SQL} SELECT row_id, CAST(l AS INT) AS L, array_to_string(tokens[1:l], ' ') AS joined
    FROM docs, (VALUES (128), (256), (512)) AS v(l)""",
)
def head_truncation(spark, sf):
    rows = split.length_variants(B.tokens(spark, sf), "tokens")
    return rows.select("row_id", "L", F.array_join("truncated_tokens", " ").alias("joined"))


@query(
    "concept_token_variants",
    f"""WITH {_WHOLE_SQL} SELECT row_id, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (tag <> 'O'), '') AS kept,
      coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (tag = 'O'), '') AS rest FROM tagged GROUP BY row_id""",
)
def concept_token_variants(spark, sf):
    words, tags = F.col("words"), F.col("tags")
    return tagged(spark, sf).select(
        "row_id",
        F.array_join(A.keep_concept_tokens(words, tags), " ").alias("kept"),
        F.array_join(A.drop_concept_tokens(words, tags), " ").alias("rest"),
    )


_IN = {
    "emotion": "tag = 'EMOTION'",
    "modality": "tag IN ('MODALITY', 'MODALITY_SCOPE')",
    "negation": "tag IN ('NEGATION', 'NEGATION_SCOPE')",
}


@query(
    "channel_word_masks",
    f"""WITH {_WHOLE_SQL} SELECT row_id, {', '.join(f"string_agg(CASE WHEN {x} THEN '1' ELSE '0' END, '' ORDER BY pos) AS {c}" for c, x in _IN.items())},
      {', '.join(f"bool_or({x}) AS has_{c}" for c, x in _IN.items())} FROM tagged GROUP BY row_id""",
)
def channel_word_masks(spark, sf):
    masks = {c: A.channel_mask(F.col("tags"), c) for c in K.CHANNELS}
    return tagged(spark, sf).select(
        "row_id",
        *[F.array_join(m.cast("array<string>"), "").alias(c) for c, m in masks.items()],
        *[A.has_concept(m).alias(f"has_{c}") for c, m in masks.items()],
    )


# -- sub-word alignment -----------------------------------------------------------------

# Every word gives ceil(length / 4) pieces; 126 pieces stay between two special slots.
_SLOTS_SQL = f"""{_HEAD_SQL},
pieces AS (SELECT row_id, pos, tag, token, unnest(range(CAST(ceil(greatest(length(token), 1) / 4) AS INT))) AS piece FROM tagged),
filled AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos, piece) AS slot FROM pieces),
slots AS (
  SELECT r.row_id, s.slot, coalesce(f.pos, -1) AS word, f.tag, f.token FROM (SELECT DISTINCT row_id FROM heads) r
    CROSS JOIN (SELECT unnest(range(128)) AS slot) s LEFT JOIN filled f ON f.row_id = r.row_id AND f.slot = s.slot AND s.slot <= 126)"""


@query(
    "subword_alignment",
    f"""WITH {_SLOTS_SQL} SELECT row_id, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY slot) AS word_index,
      CAST(count(DISTINCT word) FILTER (word >= 0) AS INT) AS n_words, CAST(least(128, 2 + max(slot) FILTER (word >= 0)) AS INT) AS attention
    FROM slots GROUP BY row_id""",
)
def subword_alignment(spark, sf):
    words = F.col("words")
    rows = tagged(spark, sf, 128).withColumn("slots", A.subword_slots(words))
    return rows.select(
        "row_id",
        F.array_join(F.col("slots").cast("array<string>"), " ").alias("word_index"),
        A.words_kept(F.col("slots")).alias("n_words"),
        A.mask_total(A.attention_slots(words)).alias("attention"),
    )


def masked_rows(spark, sf):
    rows = tagged(spark, sf, 128).withColumn("word_index", A.subword_slots(F.col("words")))
    return align.subword_masks(rows, "tags", "word_index", extra=["word_index", "words"])


@query(
    "subword_masks",
    f"""WITH {_SLOTS_SQL} SELECT row_id, {', '.join(f"string_agg(CASE WHEN {x} THEN '1' ELSE '0' END, '' ORDER BY slot) AS {c}" for c, x in _IN.items())},
      CAST({' + '.join(f'count(*) FILTER ({x})' for x in _IN.values())} AS INT) AS concept_tokens_per_row FROM slots GROUP BY row_id""",
)
def subword_masks(spark, sf):
    return masked_rows(spark, sf).select(
        "row_id",
        *[F.array_join(F.col(c).cast("array<string>"), "").alias(c) for c in K.CHANNELS],
        "concept_tokens_per_row",
    )


@query(
    "subword_coverage",
    f"""WITH {_SLOTS_SQL}, s AS (SELECT count(DISTINCT row_id) AS rows, {', '.join(f'count(*) FILTER ({x}) AS {c}' for c, x in _IN.items())} FROM slots)
    SELECT *, round((emotion + modality + negation) / (rows * 128.0::DOUBLE), 6) AS coverage, emotion + modality + negation < 1000 AS low_coverage FROM s""",
)
def subword_coverage(spark, sf):
    return summaries.subword_coverage(masked_rows(spark, sf))


@query(
    "subword_mask_by_join",
    f"WITH {_SLOTS_SQL} SELECT row_id, CAST(slot AS INT) AS slot, CASE WHEN tag = 'EMOTION' THEN 1 ELSE 0 END AS value FROM slots",
)
def subword_mask_by_join(spark, sf):
    rows = tagged(spark, sf, 128)
    mask = rows.select(
        "row_id", F.posexplode_outer(A.channel_mask(F.col("tags"), "emotion")).alias("word", "value")
    ).filter(F.col("word").isNotNull())
    slots = rows.select("row_id", F.posexplode_outer(A.subword_slots(F.col("words"))).alias("slot", "word"))
    return align.project_mask_long(mask, slots)


# -- joins by key ------------------------------------------------------------------------


_PARTS_SQL = """SELECT d.doc_id AS row_id, d.n_chars, l.quality, l.toxic, e.label AS grp FROM documents d
    JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON d.doc_id = e.vec_id"""


def _parts(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    labels = B.table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    vectors = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("grp")
    )
    return [docs, labels, vectors]


@query("join_parts_by_key", _PARTS_SQL)
def join_parts_by_key(spark, sf):
    return align.join_parts(_parts(spark, sf))


@query("join_stored_parts", _PARTS_SQL)
def join_stored_parts(spark, sf):
    paths = [scratch_path(spark, "part") for _ in range(3)]
    for part, path in zip(_parts(spark, sf), paths):
        versions.replace_bucketed(part, path, "row_id", 8)
    return align.join_stored_parts(spark, paths)


@query(
    "alignment_gaps",
    """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_first,
      (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_second""",
)
def alignment_gaps(spark, sf):
    return align.alignment_gaps(
        B.table(spark, sf, "documents"), B.table(spark, sf, "labels"), "doc_id"
    )


@query(
    "rows_behind_keys",
    "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def rows_behind_keys(spark, sf):
    wanted = B.table(spark, sf, "labels").filter(F.col("toxic") == 1)
    return align.rows_by_key(B.table(spark, sf, "documents"), wanted, "doc_id").select("doc_id", "text")


# -- attention and pooling ----------------------------------------------------------------


@query(
    "attention_in_row",
    f"""WITH {_WHOLE_SQL}, w AS (SELECT row_id, pos, length(token) / 4 AS s, {_IN['negation']} AS m FROM tagged),
    p AS (SELECT *, CASE WHEN m THEN exp(s - max(s) FILTER (m) OVER r) ELSE 0 END AS e FROM w WINDOW r AS (PARTITION BY row_id)),
    a AS (SELECT *, CASE WHEN sum(e) OVER (PARTITION BY row_id) > 0 THEN e / sum(e) OVER (PARTITION BY row_id) ELSE 0 END AS alpha FROM p)
    SELECT row_id, CAST(count(*) AS INT) AS n, round(max(alpha), 6) AS peak, round(sum(alpha * pos), 4) AS context FROM a GROUP BY row_id""",
)
def attention_in_row(spark, sf):
    scores = F.transform("words", lambda w: F.length(w) / 4)
    places = F.transform("words", lambda w, i: i.cast("double"))
    rows = tagged(spark, sf).withColumn(
        "alpha", A.masked_softmax(scores, A.channel_mask(F.col("tags"), "negation"))
    )
    return rows.select(
        "row_id",
        F.size("alpha").alias("n"),
        F.round(F.array_max("alpha"), 6).alias("peak"),
        F.round(A.weighted_context(F.col("alpha"), places), 4).alias("context"),
    )


_VECTORS_SQL = """v AS (SELECT vec_id, label, embedding, CAST(vec_id % 7 <> 0 AND label <> 3 AS INT) AS mask,
    list_sum(embedding)::DOUBLE AS score FROM embeddings)"""


def vectors(spark, sf):
    """Embeddings as token vectors: label is the row, one row is fully masked."""
    rows = B.table(spark, sf, "embeddings")
    mask = ((F.col("vec_id") % 7 != 0) & (F.col("label") != 3)).cast("int")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", "label", "embedding", mask.alias("mask"), total.alias("score"))


_ALPHA_SQL = f"""{_VECTORS_SQL},
e AS (SELECT *, CASE WHEN mask = 1 THEN exp(score - max(score) FILTER (mask = 1) OVER g) ELSE 0 END AS x FROM v WINDOW g AS (PARTITION BY label)),
a AS (SELECT *, CASE WHEN mask = 1 THEN x / sum(x) OVER (PARTITION BY label) ELSE 0 END AS alpha FROM e)"""


@query("attention_over_groups", f"WITH {_ALPHA_SQL} SELECT vec_id, label, round(alpha, 5) AS alpha FROM a")
def attention_over_groups(spark, sf):
    rows = pooling.masked_softmax(vectors(spark, sf), ["label"], "score", "mask")
    return rows.select("vec_id", "label", F.round("alpha", 5).alias("alpha"))


@query(
    "attention_context",
    f"""WITH {_ALPHA_SQL}, d AS (SELECT label, alpha, unnest(embedding) AS x, unnest(range(64)) AS dim FROM a)
    SELECT label, CAST(dim AS INT) AS dim, round(sum(alpha * x), 4) + 0 AS value FROM d GROUP BY label, dim""",
)
def attention_context(spark, sf):
    rows = pooling.masked_softmax(vectors(spark, sf), ["label"], "score", "mask")
    out = pooling.weighted_context(rows, ["label"], "embedding", "alpha", 64)
    long = out.select("label", F.posexplode_outer("context").alias("dim", "value"))
    return long.select("label", "dim", (F.round("value", 4) + 0.0).alias("value"))


_POOL_SQL = f"""WITH {_VECTORS_SQL}, d AS (SELECT label, mask, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM v),
p AS (SELECT label, dim, coalesce(avg(x) FILTER (mask = 1), 0) AS mean, coalesce(max(x) FILTER (mask = 1), -1) AS peak FROM d GROUP BY ALL)
SELECT label, CAST(dim AS INT) AS dim, round(mean, 5) + 0 AS value FROM p
UNION ALL SELECT label, CAST(dim + 64 AS INT), round(peak, 5) FROM p"""


def _pooled_rows(pooled):
    """Long form; the lowest float of an empty group is shown as -1."""
    long = pooled.select("label", F.posexplode_outer("pooled").alias("dim", "value"))
    value = F.when(F.col("value") < -1e30, -1.0).otherwise(F.round("value", 5) + 0.0)
    return long.select("label", "dim", value.alias("value"))


@query("masked_pooling", _POOL_SQL)
def masked_pooling(spark, sf):
    return _pooled_rows(pooling.masked_pool(vectors(spark, sf), "label", "embedding", "mask", 64))


@query(
    "masked_pooling_in_row",
    """WITH d AS (SELECT vec_id AS row_id, unnest([embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]]) AS part,
        unnest([1, CAST(label % 2 AS INT), 1, 0]) AS mask FROM embeddings),
    x AS (SELECT row_id, mask, unnest(part)::DOUBLE AS x, unnest(range(16)) AS dim FROM d),
    p AS (SELECT row_id, dim, avg(x) FILTER (mask = 1) AS mean, max(x) FILTER (mask = 1) AS peak FROM x GROUP BY ALL)
    SELECT row_id, CAST(dim AS INT) AS dim, round(mean, 5) + 0 AS value FROM p UNION ALL SELECT row_id, CAST(dim + 16 AS INT), round(peak, 5) + 0 FROM p""",
)
def masked_pooling_in_row(spark, sf):
    parts = F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])
    mask = F.array(F.lit(1), (F.col("label") % 2).cast("int"), F.lit(1), F.lit(0))
    rows = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        pooling.masked_pool_rows(parts, mask, 16).alias("pooled"),
    )
    long = rows.select("row_id", F.posexplode_outer("pooled").alias("dim", "value"))
    return long.select("row_id", "dim", (F.round("value", 5) + 0.0).alias("value"))
