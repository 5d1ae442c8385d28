"""What steps move, sort or send as tables grow, and that the shorter ways give the same."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimwright import session
from claimwright.functions import arrays as A, text as T
from claimwright.operators import curate, dedup, linear, vocab
from claimwright.plans import bindings, pipelines, queries_eval, queries_jobs
from claimwright.streaming import claims as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _odd_texts(n=1500):
    rng = random.Random(11)
    parts = [*"aZé9_'’!?.,<>& \t\n\x1c\x85\xa0 　́²ﬁ中٣", "  ", "n't", "N'T", "can't", "IT'S ", "'re ", "won't", "http", "www.", "hw", "<URL>", "don't ", "l'été", "US ", "12"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_patterns_that_fail_early_find_the_same(spark):
    frame = spark.createDataFrame([(t,) for t in _odd_texts()], "x string").coalesce(1)
    x, space, word = F.col("x"), T.SPACE, T.WORD
    split = F.regexp_replace(x, rf"(?i)(?<=\p{{L}})(n't)(?![{word}])", " $1")
    plain = {
        "space": F.trim(F.regexp_replace(x, f"[{space}]+", " ")),
        "tokens": F.regexp_extract_all(split, F.lit(rf"[{word}]+(?:'\p{{L}}+)*|<[^<>{space}]+>|[^{space}{word}]"), F.lit(0)),
        "urls": F.regexp_replace(x, rf"http[^{space}]+|www[^{space}]+", "<URL>"),
        "unstable": x.rlike(f"[^{T.STABLE}]"),
    }
    fast = {"space": T.collapse_space(x), "tokens": T.tokenize(x), "urls": T.mask_urls(x), "unstable": x.rlike(T.UNSTABLE)}
    rows = frame.select("x", *[c.alias(f"p_{n}") for n, c in plain.items()], *[c.alias(f"f_{n}") for n, c in fast.items()]).collect()
    for n in plain:
        assert [(r["x"], r[f"f_{n}"]) for r in rows if r[f"f_{n}"] != r[f"p_{n}"]] == []
    assert T.UNSTABLE.startswith("(?=") and T.TOKEN.startswith("(?=")


def test_contractions_are_found_as_before(spark):
    frame = spark.createDataFrame([(t,) for t in _odd_texts()], "x string").coalesce(1)
    out = F.regexp_replace("x", r"(?<=\p{L})\x{2019}(?=\p{L})", "'")
    for short, full in T.K.CONTRACTION_WORDS.items():
        out = F.regexp_replace(out, rf"(?i)(?<![{T.WORD}])({short[0]}){short[1:]}(?![{T.WORD}])", "$1" + full[1:])
    for short, full in T.K.CONTRACTION_SUFFIXES.items():
        out = F.regexp_replace(out, rf"(?i)(?<=\p{{L}}){short}(?![{T.WORD}])", full)
    rows = frame.select("x", out.alias("p"), T.expand_contractions(F.col("x")).alias("f")).collect()
    assert [tuple(r) for r in rows if r["p"] != r["f"]] == []


def test_softmax_of_odd_rows(spark):
    rows = [([1.0, 2.0, None, 2.0], [1, 1, 1, 0]), ([], []), (None, [1]), ([5.0], None), ([1.0, 1.0], [1]), ([3.0], [1, 1]), ([9.0, 9.0], [0, None])]
    frame = spark.createDataFrame(rows, "s array<double>, m array<int>").coalesce(1)
    shown = frame.select(A.masked_softmax(F.col("s"), F.col("m")).alias("a"))
    got = [r["a"] for r in shown.collect()]
    e = np.exp(-1)
    want = [[e / (1 + e), 1 / (1 + e), 0, 0], [], None, None, [1, 0], [1, 0], [0, 0]]
    assert all(g == w if not w else g == pytest.approx(w) for g, w in zip(got, want)) and len(got) == len(want)
    assert "lambda" not in _plan(shown)


def test_only_tokens_outside_the_head_become_rows(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(vocab, "settle", lambda df: stored.append(df.cache()) or stored[-1])
    words = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), (None, 5)], "token string, idx int")
    rows = [(1, ["a", "zz", None, "c", "b"]), (2, []), (3, None), (4, ["b", "c", "c", "a", "b", "b", "b"]), (5, ["c", "a"]), (5, ["a", "yy"]), (None, ["a"])]
    frame = spark.createDataFrame(rows, "row_id int, t array<string>").coalesce(1)
    got = {r["row_id"]: r["indices"] for r in vocab.encode_tokens(frame, words, "t", 6, hot=2).collect()}
    assert got == {1: [2, 1, None, 4, 3, 0], 2: [0] * 6, 3: [0] * 6, 4: [3, 4, 4, 2, 3, 3], 5: [2, 4, 1, 2, 0, 0], None: [2, 0, 0, 0, 0, 0]}
    (first,) = stored
    assert first.count() == len(rows) and first.select(F.sum(F.size("misses"))).first()[0] == 6


def test_examples_are_ranked_without_their_texts(spark):
    rows = [(k // 2 if k < 20 else None if k == 20 else k, k % 2, k % 3 % 2, k / 50, "text" * k) for k in range(40)]
    frame = spark.createDataFrame(rows, "row_id int, has_meta int, label int, em double, claim string").withColumns({"mo": F.lit(0.1), "ne": F.lit(0.0)})
    frame.unionByName(frame).repartition(4).createOrReplaceTempView("examples")
    picked = curate.round_robin(spark.table("examples"), 6)
    got = picked.orderBy("example").collect()
    order = sorted(rows * 2, key=lambda r: (-max(r[3], 0.1), r[0] is not None, r[0] or 0))
    best = {}
    for r in order:
        best.setdefault(("political" if r[1] else "health", r[2]), []).append(r[4])
    turns = [t for k in range(6) for d, c in curate.BUCKET_ORDER for t in best[d, c][k : k + 1]][:6]
    assert [r["claim"] for r in got] == turns
    assert "LeftSemi" in _optimised(picked)


def test_passes_send_one_matrix_a_core(spark, monkeypatch):
    tasks = []
    sums = linear._tree_sum
    monkeypatch.setattr(linear, "_tree_sum", lambda frame, n: tasks.append(n) or sums(frame, n))
    rows = spark.range(200).select(F.array(F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("truncated_tokens"), (F.col("id") % 2).alias("label"), F.lit(1.0).alias("w"))
    models = linear.fit_models(rows.repartition(30), [linear.Setting("a", 0.1, "w")], meta=None, iterations=3)
    assert max(tasks) <= spark.sparkContext.defaultParallelism < 30
    # Scores need no other column in Python, so one that is not asked for is not even computed.
    scored = linear.margins(models, rows.withColumn("text", F.lit("claim")), meta=None)
    assert "claim" not in _optimised(scored.select("label", "margins"))


def test_streams_move_counters_and_no_codes(spark):
    frame = spark.createDataFrame([(None, "a")], "event_time timestamp, statement string")
    rates = S.window_rates(frame, "1 hour", "2 hours")
    exchanged = [line for line in _plan(rates).splitlines() if "text_key" in line and "HashAggregate" in line]
    assert exchanged and all("codes" not in line for line in exchanged)


def test_attention_reaches_python_in_small_batches(spark, tmp_path, monkeypatch):
    @F.arrow_udf("array<double>")
    def rows_of_batch(scores: pa.Array, mask: pa.Array) -> pa.Array:
        return pa.array([[float(len(scores))] * n for n in scores.value_lengths().to_pylist()], pa.list_(pa.float64()))

    monkeypatch.setattr(queries_eval.A, "masked_softmax", lambda scores, mask: rows_of_batch(scores, mask))
    texts = spark.range(8000).selectExpr("id as doc_id", "'the and of' as text", "'en' as lang", "'s' as source", "10L as n_chars")
    texts.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(session.ARROW_ROWS)
    top = queries_eval.top_words_by_channel(spark, str(tmp_path))
    assert top.count() == 8000 * 3 * 3 and 0 < top.agg(F.max("alpha")).first()[0] <= 1000
    assert spark.conf.get(session.ARROW_ROWS) == before


def test_batches_stay_as_small_as_the_session_wants_them(spark):
    before = spark.conf.get(session.ARROW_ROWS)
    try:
        for own, rows in (("10", "10"), ("5000", "1000"), ("0", "1000")):
            spark.conf.set(session.ARROW_ROWS, own)
            with session.arrow_rows(spark, 1000):
                assert spark.conf.get(session.ARROW_ROWS) == rows
            assert spark.conf.get(session.ARROW_ROWS) == own
    finally:
        spark.conf.set(session.ARROW_ROWS, before)


def test_encoded_splits_store_texts_and_tokens_once(spark, tmp_path, monkeypatch):
    stored, settle = [], session.settle

    def recorded(df, *args, **kwargs):
        stored.append(df.columns)
        return settle(df, *args, **kwargs)

    for module in (pipelines, queries_jobs):
        monkeypatch.setattr(module, "settle", recorded)
    texts = spark.range(60).selectExpr("id as doc_id", "concat('the claim of case', id % 40, ' and more') as text", "'en' as lang", "'s' as source", "10L as n_chars")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries_jobs.encoded_splits(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(len(r["indices"].split()) == 128 for r in got)
    assert sum("clean_statement" in c for c in stored) == 1 and sum("tokens" in c for c in stored) == 1
    assert not any({"statement", "normalized_text", "truncated_tokens"} & set(c) for c in stored)
    # Tags are still made and stored with the rows they belong to.
    assert [c for c in stored if "tokens" in c] == [["row_id", "label", "tokens", "concept_tags", "binary_label"]]


def test_named_columns_of_a_corpus_are_those_of_the_whole(spark):
    rows = [(k, f"The claim <b>of</b> case{k % 30} isn't new", "true" if k % 3 else "false", "s") for k in range(50)]
    raw = spark.createDataFrame(rows, "row_id long, statement string, label string, speaker string")
    whole = pipelines.political_corpus(raw)
    some = pipelines.political_corpus(raw, columns=["speaker", "concept_tags"])
    assert some.columns == ["binary_label", "row_id", "speaker", "concept_tags", "split"]
    assert sorted(some.collect()) == sorted(whole.select(some.columns).collect()) and some.count() == 30


@pytest.fixture
def no_own_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_first_copies_are_kept_without_moving_texts(spark, monkeypatch, no_own_broadcasts):
    rows = [(5, "a"), (2, "a"), (3, "b"), (4, None), (1, None), (6, "c"), (None, "c"), (7, "d"), (7, "d"), (8, "d")]
    frame = spark.createDataFrame(rows * 2, "row_id long, t string")
    want = sorted([(2, "a"), (3, "b"), (1, None), (None, "c"), (7, "d"), (7, "d")] * 2, key=str)
    kept = dedup.keep_first(frame, "t", ["row_id"])
    assert re.findall(r"\w+Join", _plan(kept))[0] == "BroadcastHashJoin"  # the one that texts go through
    assert sorted(map(tuple, kept.collect()), key=str) == want
    monkeypatch.setattr(dedup, "MAX_GONE", 1)
    moved = dedup.keep_first(frame, "t", ["row_id"])
    assert re.findall(r"\w+Join", _plan(moved))[0] == "SortMergeJoin" and sorted(map(tuple, moved.collect()), key=str) == want


def test_claims_get_their_labels_without_moving_texts(spark, tmp_path, no_own_broadcasts):
    texts = spark.range(20).selectExpr("id as doc_id", "'one claim' as text", "'en' as lang", "'s' as source", "10L as n_chars")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(10).selectExpr("id * 2 as doc_id", "1 as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    claims = bindings.claims(spark, str(tmp_path))
    assert "SortMergeJoin" not in _plan(claims) and claims.count() == 20 and claims.filter("context = 'en speech'").count() == 10
