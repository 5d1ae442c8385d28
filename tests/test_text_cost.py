"""What the text steps leave out: work on rows that need none, and second readings."""

import unicodedata

from pyspark.sql import functions as F

from claimwright.functions import concepts as C, text as T
from claimwright.operators import rationale
from claimwright.plans import pipelines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_are_made_once_for_each_distinct_token(spark):
    frame = spark.createDataFrame([(["not", None, "a", "-", "b"],), (None,), ([],)], "t array<string>")
    codes = frame.select(C.concept_codes(F.col("t"), C.Lexicon(negation=("not",), skip=())).alias("c"))
    assert "ArrowEvalPython" in _plan(codes) and "lambda" not in _plan(codes)
    assert [r["c"] for r in codes.collect()] == [[20, 2, 2, 0, 2], None, []]


def test_a_cue_that_is_a_boundary_or_skipped_still_reaches(spark):
    words = C.Lexicon(emotion=("joy",), negation=("no", "but"), modality=("may",), skip=("no",), boundaries=("but",))
    rows = [["may", "no", "x", "but", "y", "z", "u", "v"], ["joyn't", "x"], ["JOY", "'No'", "x"]]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t array<string>").coalesce(1)
    found = frame.select("k", C.concept_codes(F.col("t"), words).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in found] == [[30, 20, 3, 20, 2, 2, 2, 0], [20, 2], [10, 20, 2]]


def test_texts_of_stable_characters_stay_out_of_python(spark):
    texts = [("déjà-vu “so”",), ("plain",), (None,)]
    frame = spark.createDataFrame(texts, "t string")
    assert frame.where(F.col("t").rlike(T.UNSTABLE)).count() == 0
    assert [r[0] for r in frame.select(T.nfkc(F.col("t"))).collect()] == [t for (t,) in texts]
    odd = [chr(c) for c in range(1, 0x3000) if unicodedata.normalize("NFKC", chr(c)) != chr(c) or unicodedata.combining(chr(c))]
    odd = spark.createDataFrame([(c,) for c in odd if not 0xD800 <= ord(c) < 0xE000], "t string")
    assert odd.where(~F.col("t").rlike(T.UNSTABLE)).count() == 0


def test_claims_are_cleaned_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(text):
        seen.add(1)
        return text

    raw = spark.createDataFrame([(1, "A b", "true"), (2, "a B", "true"), (3, "c", "false")], "row_id long, statement string, label string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("subject", "speaker", "party", "context")})
    clean = pipelines.clean_claims(raw.withColumn("statement", count.asNondeterministic()("statement")))
    assert sorted(r["row_id"] for r in clean.collect()) == [1, 3]
    assert seen.value == 3


def test_top_subwords_make_their_list_once(spark):
    frame = spark.createDataFrame([([0.2, 0.4, 0.4, 0.0], ["a", "##b", "c", "d"])], "a array<double>, p array<string>")
    ones = F.transform("p", lambda w: F.lit(1))
    text = rationale.format_top_tokens(rationale.top_subwords(F.col("a"), F.col("p"), ones, ones, 2))
    shown = frame.select(text.alias("t"))
    assert _plan(shown).count("arrays_zip") == 1
    assert shown.first()["t"] == '"b" (α=0.40), "c" (α=0.40)'
