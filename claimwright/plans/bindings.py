"""Roles of the test tables, as Spark frames and as the SQL the oracles start from.

Each frame has a ``..._SQL`` twin that builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.functions import maths as M, text as T
from claimwright.functions.concepts import Lexicon
from claimwright.session import broadcast_if_small, spread

#: Labels that are sent to every task, about 100 MB there.
MAX_LABELS = 2_000_000

TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


# -- lexicon: stop words of the corpus, so that every rule fires --------------

TEST_LEXICON = Lexicon(
    emotion=("the", "la", "der", "él"),
    negation=("of", "de", "und", "not"),
    modality=("and", "en", "for", "für"),
    skip=("a", "in", "is", "que", "le", "die", "and"),
)


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# -- text fragments ----------------------------------------------------------

SPACE = r"\t-\r\x1c-\x20\x{85}\pZ"
WORD = r"\pL\pN_"


def sql_mask_urls(x: str) -> str:
    return f"regexp_replace({x}, 'http[^{SPACE}]+|www[^{SPACE}]+', '<URL>', 'g')"


def sql_runs(x: str, cases: str) -> str:
    """Rewrite whole runs of word characters; RE2 has no look-around."""
    return (
        f"array_to_string([CASE {cases} ELSE r END "
        f"for r in regexp_extract_all({x}, '[{WORD}]+|[^{WORD}]+')], '')"
    )


CAPS_CASE = "WHEN regexp_full_match(r, '[A-Z]{2,}') THEN '<ALLCAPS> ' || r"
NUMBER_CASE = r"WHEN regexp_full_match(r, '\p{Nd}+') THEN '<NUM>'"


def sql_collapse_marks(x: str) -> str:
    return rf"regexp_replace({x}, '([!?]){{2,}}', '\1', 'g')"


def sql_collapse_punct(x: str) -> str:
    return rf"regexp_replace({x}, '([.,!?]){{2,}}', '\1', 'g')"


def sql_collapse_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), ' ')"


def sql_trim_space(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_clean_basic(x: str) -> str:
    marked = sql_runs(sql_mask_urls(x), f"{CAPS_CASE} {NUMBER_CASE}")
    return f"lower({sql_collapse_marks(marked)})"


def sql_strip_prefix(x: str) -> str:
    words = [
        "fake", "false", "real", "true", "debunked", r"fact[-\s]?check(ed)?", "hoax", "myth",
        "misinformation", "misleading", "claim(ed)?",
    ]
    for word in words * 2:
        x = rf"regexp_replace({x}, '(?i)^[{SPACE}]*{word}[{SPACE}]*[:!\-][{SPACE}]*', '')"
    return x


def sql_tokens(x: str) -> str:
    return (
        f"regexp_extract_all({x}, "
        rf"'<[^<>{SPACE}]+>|[{WORD}]+(?:''\pL+)*|[^{SPACE}{WORD}]')"
    )


# -- claims: documents with their labels -------------------------------------

CLAIMS_SQL = """claims AS (
  SELECT d.doc_id AS row_id, d.text AS statement,
    CASE WHEN l.quality = 0 THEN CASE d.n_chars % 3 WHEN 0 THEN 'pants-fire' WHEN 1 THEN 'false' ELSE 'barely-true' END
         WHEN l.quality = 1 THEN CASE d.n_chars % 3 WHEN 0 THEN 'half-true' WHEN 1 THEN 'mostly-true' ELSE 'true' END
         WHEN d.lang = 'es' THEN NULL
         WHEN d.n_chars % 2 = 0 THEN ' FALSE ' ELSE 'true' END AS label,
    d.lang || ', ' || d.source AS subject, d.source AS speaker,
    CASE d.lang WHEN 'en' THEN 'Republican ' WHEN 'fr' THEN 'DEMOCRAT' WHEN 'de' THEN 'pirate' END AS party,
    CASE WHEN l.toxic IS NULL THEN NULL ELSE CAST(d.n_chars % 7 AS DOUBLE) END AS barely_true_count,
    CAST(d.n_chars % 11 AS DOUBLE) AS false_count, CAST(d.n_chars % 13 AS DOUBLE) AS half_true_count,
    CAST(d.n_chars % 17 AS DOUBLE) AS mostly_true_count, CAST(d.n_chars % 19 AS DOUBLE) AS pants_fire_count,
    CASE WHEN l.quality = 1 THEN d.lang || ' speech' END AS context
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # Whole texts stay where they are as long as the labels can go to them.
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = d.join(broadcast_if_small(labels, MAX_LABELS), "doc_id", "left")
    n = F.col("n_chars")

    def pick(a, b, c):
        return F.when(n % 3 == 0, a).when(n % 3 == 1, b).otherwise(c)

    label = (
        F.when(F.col("quality") == 0, pick("pants-fire", "false", "barely-true"))
        .when(F.col("quality") == 1, pick("half-true", "mostly-true", "true"))
        .when(F.col("lang") == "es", None)
        .when(n % 2 == 0, " FALSE ")
        .otherwise("true")
    )
    party = (
        F.when(F.col("lang") == "en", "Republican ")
        .when(F.col("lang") == "fr", "DEMOCRAT")
        .when(F.col("lang") == "de", "pirate")
    )
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("statement"),
        label.alias("label"),
        F.concat_ws(", ", "lang", "source").alias("subject"),
        F.col("source").alias("speaker"),
        party.alias("party"),
        F.when(F.col("toxic").isNotNull(), (n % 7).cast("double")).alias("barely_true_count"),
        (n % 11).cast("double").alias("false_count"),
        (n % 13).cast("double").alias("half_true_count"),
        (n % 17).cast("double").alias("mostly_true_count"),
        (n % 19).cast("double").alias("pants_fire_count"),
        F.when(F.col("quality") == 1, F.concat("lang", F.lit(" speech"))).alias("context"),
    )


# -- headlines: conversations as a corpus without metadata -------------------

HEADLINES_SQL = """headlines AS (
  SELECT conv_id * 10000 + turn AS row_id,
    CASE turn % 4 WHEN 0 THEN 'FAKE: fact-check - ' || text WHEN 1 THEN ' Claimed! ' || text
         WHEN 2 THEN 'Real-' || text ELSE text END AS statement,
    CASE WHEN turn % 3 = 0 THEN 'fake' ELSE 'real' END AS label,
    CASE WHEN role = 'user' THEN 'claim' ELSE 'news' END AS subset
  FROM conversations)"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn, text = F.col("turn"), F.col("text")
    statement = (
        F.when(turn % 4 == 0, F.concat(F.lit("FAKE: fact-check - "), text))
        .when(turn % 4 == 1, F.concat(F.lit(" Claimed! "), text))
        .when(turn % 4 == 2, F.concat(F.lit("Real-"), text))
        .otherwise(text)
    )
    return c.select(
        (F.col("conv_id") * 10000 + turn).alias("row_id"),
        statement.alias("statement"),
        F.when(turn % 3 == 0, "fake").otherwise("real").alias("label"),
        F.when(F.col("role") == "user", "claim").otherwise("news").alias("subset"),
    )


# -- token lists of whole documents ------------------------------------------

TOKENS_SQL = f"""docs AS (
  SELECT doc_id AS row_id, lang, source, n_chars, {sql_tokens(sql_clean_basic('text'))} AS tokens FROM documents)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        "lang",
        "source",
        "n_chars",
        T.tokenize(T.clean_basic(F.col("text"))).alias("tokens"),
    )


def sql_tagged(source: str, lexicon: Lexicon = TEST_LEXICON) -> str:
    """CTEs from ``source(row_id, tokens)`` to ``tagged(row_id, pos, token, cue, reach, tag)``."""
    return rf"""words AS (
  SELECT row_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM {source}),
kinds AS (
  SELECT row_id, pos, token,
    CASE WHEN k IN {sql_list(lexicon.emotion)} THEN 'EMOTION'
         WHEN k IN {sql_list(lexicon.negation)} OR ends_with(k, 'n''t') THEN 'NEGATION'
         WHEN k IN {sql_list(lexicon.modality)} THEN 'MODALITY' END AS cue,
    CASE WHEN token IN {sql_list(lexicon.boundaries)} THEN 'boundary'
         WHEN k IN {sql_list(lexicon.skip)} OR regexp_full_match(token, '[^\pL\pN]+') THEN 'skip'
         ELSE 'content' END AS kind
  FROM (SELECT *, trim(lower(token), '''`"') AS k FROM words)),
counted AS (
  SELECT *, sum((kind = 'boundary')::INT) OVER w AS seg, sum((kind = 'content')::INT) OVER w AS cc
  FROM kinds WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
reached AS (
  SELECT row_id, pos, token, cue, kind,
    min(CASE cue WHEN 'NEGATION' THEN pos * 2 WHEN 'MODALITY' THEN pos * 2 + 1 END) OVER (
      PARTITION BY row_id, seg ORDER BY cc RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS src
  FROM counted),
scoped AS (
  SELECT *, CASE WHEN kind = 'content' AND src IS NOT NULL
    THEN CASE src % 2 WHEN 0 THEN 'NEGATION' ELSE 'MODALITY' END END AS reach FROM reached),
tagged AS (
  SELECT row_id, pos, token, cue, reach, coalesce(cue, reach || '_SCOPE', 'O') AS tag FROM scoped)"""


# -- predictions: one scored row per document --------------------------------

SCORED_SQL = """scored0 AS (
  SELECT d.doc_id AS row_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INT)) AS label,
    (d.n_chars % 97)::DOUBLE / 10 - 4.85::DOUBLE AS logit0,
    (d.doc_id * 7 % 89)::DOUBLE / 10 - 4.4::DOUBLE AS logit1,
    CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS has_meta,
    (d.doc_id * 13 % 101)::DOUBLE / 100 AS em, (d.n_chars * 7 % 101)::DOUBLE / 100 AS mo,
    ((d.doc_id * 31 + d.n_chars) % 101)::DOUBLE / 100 AS ne,
    d.text AS claim
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
scored AS (
  SELECT *, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS pred,
    1 / (1 + exp(least(logit0, logit1) - greatest(logit0, logit1))) AS conf FROM scored0)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key, n = F.col("doc_id"), F.col("n_chars")
    rows = d.select(
        key.alias("row_id"),
        F.coalesce("quality", (n % 2).cast("int")).alias("label"),
        ((n % 97) / 10 - 4.85).alias("logit0"),
        ((key * 7 % 89) / 10 - 4.4).alias("logit1"),
        (F.col("lang") == "en").cast("int").alias("has_meta"),
        ((key * 13 % 101) / 100).alias("em"),
        ((n * 7 % 101) / 100).alias("mo"),
        (((key * 31 + n) % 101) / 100).alias("ne"),
        F.col("text").alias("claim"),
    )
    return rows.withColumns(
        {
            "pred": M.predicted_class(F.col("logit0"), F.col("logit1")),
            "conf": M.confidence(F.col("logit0"), F.col("logit1")),
        }
    )


# -- order claims: many distinct speakers ------------------------------------

ORDER_CLAIMS_SQL = """credit AS (
  SELECT o_custkey,
    count(*) FILTER (o_orderpriority LIKE '1%') AS c1, count(*) FILTER (o_orderpriority LIKE '2%') AS c2,
    count(*) FILTER (o_orderpriority LIKE '3%') AS c3, count(*) FILTER (o_orderpriority LIKE '4%') AS c4,
    count(*) FILTER (o_orderpriority LIKE '5%') AS c5
  FROM orders GROUP BY o_custkey),
order_claims AS (
  SELECT o.o_orderkey AS row_id,
    CASE WHEN o.o_totalprice < 150000 THEN 'fake' ELSE 'real' END AS binary_label,
    CASE WHEN o.o_orderstatus = 'P' THEN 0 ELSE 1 END AS has_meta,
    CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE ' ' || upper(c.c_name) END AS speaker,
    CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_mktsegment || ', ' || o.o_orderpriority END AS subject,
    n.n_name AS context,
    CASE c.c_nationkey % 5 WHEN 0 THEN 'Republican' WHEN 1 THEN ' democrat' WHEN 2 THEN 'green' WHEN 3 THEN 'pirate' END AS party,
    k.c1 AS barely_true_count, k.c2 AS false_count, k.c3 AS half_true_count,
    CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE k.c4 END AS mostly_true_count, k.c5 AS pants_fire_count
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN credit k ON o.o_custkey = k.o_custkey)"""


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    credit = orders.groupBy("o_custkey").agg(
        *[F.count_if(priority.startswith(str(i))).alias(f"c{i}") for i in range(1, 6)]
    )
    partial = F.col("o_orderstatus") == "P"
    nation = F.col("c_nationkey") % 5
    # Spark sizes these joins itself: the nations are a handful, the rest may be large.
    rows = (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(credit, "o_custkey")
    )
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_totalprice") < 150000, "fake").otherwise("real").alias("binary_label"),
        F.when(partial, 0).otherwise(1).alias("has_meta"),
        F.when(partial, "").otherwise(F.concat(F.lit(" "), F.upper("c_name"))).alias("speaker"),
        F.when(F.col("c_acctbal") < 0, None)
        .otherwise(F.concat_ws(", ", "c_mktsegment", "o_orderpriority"))
        .alias("subject"),
        F.col("n_name").alias("context"),
        F.when(nation == 0, "Republican").when(nation == 1, " democrat").when(nation == 2, "green")
        .when(nation == 3, "pirate").alias("party"),
        F.col("c1").alias("barely_true_count"),
        F.col("c2").alias("false_count"),
        F.col("c3").alias("half_true_count"),
        F.when(~partial, F.col("c4")).alias("mostly_true_count"),
        F.col("c5").alias("pants_fire_count"),
    )


def sql_split(source: str, strata: str, key: str = "row_id", seed=42) -> str:
    """CTE ``split_rows``: the plain window form of the split."""
    return f"""split_rows AS (
  SELECT * EXCLUDE (rk, n), CASE WHEN rk <= (n * 70 + 50) // 100 THEN 'train'
    WHEN rk <= (n * 85 + 50) // 100 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5({key} || '|{seed}'), {key}) AS rk,
          count(*) OVER (PARTITION BY {strata}) AS n FROM {source}))"""


# -- runs: events by day as epochs, orders as finished runs ------------------

EPOCHS_SQL = """epochs AS (
  SELECT event_type AS tag, CAST(41 + user_id % 3 AS INT) AS seed,
    CAST(1 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS epoch,
    round(avg(value) / 100, 6) AS val_macro_f1
  FROM events GROUP BY ALL)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return e.groupBy(
        F.col("event_type").alias("tag"),
        (41 + F.col("user_id") % 3).cast("int").alias("seed"),
        day.cast("int").alias("epoch"),
    ).agg(F.round(F.avg("value") / 100, 6).alias("val_macro_f1"))


RESULTS_SQL = """results AS (
  SELECT CAST(CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 4 END AS INT) AS phase,
    CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'frozen' ELSE 'tuned' END || '_' ||
    CASE WHEN o_orderpriority < '3' THEN 'single' ELSE 'merged' END AS setting,
    CAST(41 + o_custkey % 3 AS INT) AS seed, round(avg(o_totalprice) / 1000000, 6) AS test_macro_f1
  FROM orders GROUP BY ALL)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tuned = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "frozen").otherwise("tuned")
    merged = F.when(F.col("o_orderpriority") < "3", "single").otherwise("merged")
    return o.groupBy(
        F.when(F.col("o_orderstatus") == "O", 3).otherwise(4).alias("phase"),
        F.concat_ws("_", tuned, merged).alias("setting"),
        (41 + F.col("o_custkey") % 3).cast("int").alias("seed"),
    ).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("test_macro_f1"))
