"""Sources and sinks: tables written out in each format and read back.

Everything goes to a fresh path in the session's shared folder.
"""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from claimwright import constants as K, schemas
from claimwright.functions import arrays as A, concepts as C
from claimwright.operators import cleaning, metrics, rationale, split, summaries
from claimwright.plans import bindings as B
from claimwright.plans.registry import query
from claimwright.session import scratch_path, settle
from claimwright.sources import readers, sinks, versions



@query(
    "claims_from_tsv",
    f"""WITH {B.CLAIMS_SQL}, n AS (SELECT c.*, CASE d.lang WHEN 'en' THEN 0 WHEN 'es' THEN 2 ELSE 1 END AS file
      FROM claims c JOIN documents d ON c.row_id = d.doc_id)
    SELECT row_number() OVER (ORDER BY file, row_id) - 1 AS row_id, * EXCLUDE (row_id, file) FROM n""",
)
def claims_from_tsv(spark, sf):
    # Three header-less files, each written in row order, so that ids can be compared. Two of
    # them have the same name, and statements keep their line breaks.
    rows = B.claims(spark, sf)
    raw = rows.select(
        "row_id",
        *[
            (F.col(c) if c in rows.columns else F.lit("x")).alias(c)
            for c in schemas.RAW_POLITICAL.names
        ],
    )
    folder = scratch_path(spark, "tsv")
    lang = F.element_at(F.split("subject", ","), 1)
    place = F.when(lang == "en", 0).when(lang == "es", 2).otherwise(1)
    names = ("b/claims", "a/claims", "test")
    for i, name in enumerate(names):
        part = raw.filter(place == i)
        (
            part.orderBy("row_id").drop("row_id")
            .write.option("sep", "\t").option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{name}.tsv")
        )
    return readers.read_political_tsv(spark, [f"{folder}/{name}.tsv" for name in names])


@query("stage_table_csv", f"WITH {B.CLAIMS_SQL} SELECT row_id, label, statement, barely_true_count FROM claims")
def stage_table_csv(spark, sf):
    rows = B.claims(spark, sf).select("row_id", "label", "statement", "barely_true_count")
    path = scratch_path(spark, "stage")
    sinks.write_stage(rows, path, "csv")
    return readers.read_header_csv(spark, path, rows.schema)


@query(
    "stage_table_parquet",
    f"WITH {B.TOKENS_SQL} SELECT row_id, array_to_string(tokens, ' ') AS joined FROM docs",
)
def stage_table_parquet(spark, sf):
    path = scratch_path(spark, "stage")
    sinks.write_stage(B.tokens(spark, sf).select("row_id", "tokens"), path)
    stored = readers.read_arrays(spark, path, ["row_id", "tokens"])
    return stored.select("row_id", F.array_join("tokens", " ").alias("joined"))


@query(
    "snapshot_files",
    f"""WITH {B.HEADLINES_SQL} SELECT statement, label, subset,
      CASE subset WHEN 'claim' THEN 'Claim' ELSE 'News' END || CASE label WHEN 'fake' THEN 'Fake' ELSE 'Real' END || 'COVID-19.csv' AS source_file
    FROM headlines""",
)
def snapshot_files(spark, sf):
    # Four valid files with two header layouts, one name that says both, one without a title.
    rows = settle(B.headlines(spark, sf))
    folder = scratch_path(spark, "snapshots")

    def write(frame, name):
        (
            frame.write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{name}{readers.SNAPSHOT_SUFFIX}")
        )

    flat = rows.withColumnRenamed("statement", "title")
    for subset, first in (("claim", "Claim"), ("news", "News")):
        for label, second in (("fake", "Fake"), ("real", "Real")):
            part = flat.filter((F.col("subset") == subset) & (F.col("label") == label))
            columns = ["row_id", "title"] if subset == "claim" else ["title", "label", "row_id"]
            write(part.select(*columns), first + second)
    write(flat.select("row_id", "title"), "ClaimNewsFake")
    write(flat.select("row_id", "label"), "NewsRealUntitled")
    found = readers.read_snapshots(spark, folder)
    return found.select("statement", "label", "subset", "source_file")


@query(
    "array_cache",
    "SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(list_sum(embedding)::DOUBLE, 4) AS total FROM embeddings",
)
def array_cache(spark, sf):
    path = scratch_path(spark, "arrays")
    sinks.write_stage(B.table(spark, sf, "embeddings"), path)
    stored = readers.read_arrays(spark, path, ["vec_id", "embedding"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.select("vec_id", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


@query(
    "materialized_cache",
    """SELECT lang, count(*) AS n, CAST(sum(n_chars + 1) AS BIGINT) AS total, true AS first_wrote, false AS second_wrote, true AS third_wrote
    FROM documents GROUP BY lang""",
)
def materialized_cache(spark, sf):
    # Written, found up to date, then rebuilt because values have changed under the same keys.
    rows = B.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars", "lang")
    path = scratch_path(spark, "cache")
    _, first = sinks.materialize(rows, path)
    _, second = sinks.materialize(rows, path)
    table, third = sinks.materialize(rows.withColumn("n_chars", F.col("n_chars") + 1), path)
    return table.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total")).select(
        "lang", "n", "total",
        F.lit(first).alias("first_wrote"),
        F.lit(second).alias("second_wrote"),
        F.lit(third).alias("third_wrote"),
    )


@query(
    "replaced_table",
    """SELECT which, lang, count(*) AS n, CAST(sum(n_chars + shift) AS BIGINT) AS total FROM documents,
      (VALUES ('now', 2), ('before', 1)) AS v(which, shift) GROUP BY which, lang""",
)
def replaced_table(spark, sf):
    # Three versions, the later ones made from the one before; a write that fails half-way in
    # between, and a reader that started before the last commit.
    path = scratch_path(spark, "replaced")
    sinks.write_stage(B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path)

    def shifted(fail=False):
        more = F.when(F.col("doc_id") == 0, F.raise_error(F.lit("stopped"))).otherwise(1) if fail else F.lit(1)
        return versions.read(spark, path).withColumn("n_chars", F.col("n_chars") + more)

    sinks.write_stage(shifted(), path)
    try:
        sinks.write_stage(shifted(fail=True), path)
    except PySparkException as stopped:
        if "stopped" not in str(stopped):
            raise
    before = versions.read(spark, path)
    sinks.write_stage(shifted(), path)
    both = before.withColumn("which", F.lit("before")).unionByName(versions.read(spark, path).withColumn("which", F.lit("now")))
    return both.groupBy("which", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query(
    "variant_tables",
    f"""WITH {B.TOKENS_SQL}, {B.sql_split('docs', 'lang')}
    SELECT CAST(l AS INT) AS L, split, count(*) AS n, CAST(sum(least(len(tokens), l)) AS BIGINT) AS kept_tokens
    FROM split_rows, (VALUES (128), (256), (512)) AS v(l) GROUP BY l, split""",
)
def variant_tables(spark, sf):
    docs = settle(B.tokens(spark, sf).select("row_id", "lang", "tokens"))
    rows = split.length_variants(split.stratified_split(docs, ["lang"]), "tokens")
    path = scratch_path(spark, "variants")
    sinks.write_variants(rows.drop("tokens"), path)
    stored = versions.read(spark, path)
    return stored.groupBy("L", "split").agg(
        F.count("*").alias("n"), F.sum(F.size("truncated_tokens")).alias("kept_tokens")
    )


@query(
    "split_tables",
    f"""WITH {B.ORDER_CLAIMS_SQL}, {B.sql_split('order_claims', 'binary_label')}
    SELECT split, count(*) AS n FROM split_rows GROUP BY split""",
)
def split_tables(spark, sf):
    rows = settle(B.order_claims(spark, sf).select("row_id", "binary_label"))
    path = scratch_path(spark, "splits")
    sinks.write_splits(split.stratified_split(rows, ["binary_label"]), path)
    return versions.read(spark, path).groupBy("split").agg(F.count("*").alias("n"))


@query(
    "class_weight_file",
    """SELECT CASE quality WHEN 0 THEN 'fake' ELSE 'real' END || chr(9) || printf('%.6f', sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS value
    FROM labels GROUP BY quality""",
)
def class_weight_file(spark, sf):
    rows = B.table(spark, sf, "labels").select(
        F.when(F.col("quality") == 0, "fake").otherwise("real").alias("binary_label")
    )
    weights = summaries.class_weights(rows)
    path = scratch_path(spark, "weights")
    sinks.write_key_values(
        weights.select("binary_label", F.format_string("%.6f", "weight").alias("weight")), path
    )
    return spark.read.text(path)


@query(
    "vocabulary_file",
    "SELECT lang AS value, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS INT) AS idx FROM documents GROUP BY lang",
)
def vocabulary_file(spark, sf):
    from claimwright.operators import vocab

    words = vocab.top_values(B.table(spark, sf, "documents"), "lang", "doc_id", 80)
    path = scratch_path(spark, "vocab")
    sinks.write_vocab(words, path)
    return spark.read.schema("value string, cnt long, idx int").json(path)


@query(
    "run_log",
    """SELECT 'merge' AS step, CAST(count(*) AS VARCHAR) AS n, CAST(count(*) FILTER (toxic = 1) AS VARCHAR) AS toxic FROM labels
    UNION ALL SELECT 'clean', CAST(count(*) AS VARCHAR), NULL FROM documents""",
)
def run_log(spark, sf):
    path = scratch_path(spark, "log")
    labels = B.table(spark, sf, "labels")
    n = F.count("*").alias("n")
    sinks.append_log(spark, path, "merge", {"n": 0, "old": 1})
    sinks.append_log(spark, path, "clean", B.table(spark, sf, "documents").agg(n))
    sinks.append_log(
        spark, path, "merge", labels.agg(n, F.count_if(F.col("toxic") == 1).alias("toxic"))
    )
    log = sinks.read_log(spark, path)
    return log.select("step", F.col("metrics")["n"].alias("n"), F.col("metrics")["toxic"].alias("toxic"))


@query("epoch_log", f"WITH {B.EPOCHS_SQL} SELECT tag, seed, epoch, val_macro_f1 FROM epochs")
def epoch_log(spark, sf):
    rows = B.epochs(spark, sf)
    rows = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(0.0)).cast(f.dataType).alias(f.name)
            for f in schemas.EPOCH
        ]
    )
    rows = settle(rows)
    path = scratch_path(spark, "epochs")
    sinks.append_epochs(rows.filter(F.col("epoch") <= 10), path)
    sinks.append_epochs(rows.filter(F.col("epoch") > 10), path)
    return spark.read.schema(schemas.EPOCH).parquet(path).select("tag", "seed", "epoch", "val_macro_f1")


@query("result_files", f"WITH {B.RESULTS_SQL} SELECT setting AS tag, phase, seed, test_macro_f1 FROM results")
def result_files(spark, sf):
    rows = B.results(spark, sf).withColumnRenamed("setting", "tag")
    path = scratch_path(spark, "results")
    sinks.append_result(rows.filter(F.col("phase") == 3), path)
    # The other phase as indented objects, the form of a record that a person reads.
    others = rows.filter(F.col("phase") == 4)
    columns = [c for c in schemas.RESULT.names if c in others.columns]
    others.select(F.to_json(F.struct(*columns), {"pretty": "true"})).write.text(f"{path}-indented")
    return readers.read_results(spark, [f"{path}/*.json", f"{path}-indented/*.txt"]).select("tag", "phase", "seed", "test_macro_f1")


@query(
    "rationale_file",
    f"""WITH {B.SCORED_SQL} SELECT '--- example ' || row_number() OVER (ORDER BY row_id) || ' --- ' || row_id AS value
    FROM (SELECT * FROM scored ORDER BY row_id LIMIT 10)""",
)
def rationale_file(spark, sf):
    cards = rationale.sample_rationales(B.scored(spark, sf), F.col("row_id").cast("string"))
    path = scratch_path(spark, "cards")
    line = F.trim(F.regexp_replace("block", "\\s+", " "))
    sinks.write_cards(cards.withColumn("block", line), "block", path, "example")
    return spark.read.text(path)
