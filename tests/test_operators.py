import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimwright.operators import (
    align, cleaning, curate, dedup, metadata, metrics, pooling, ranking, rationale, runs,
    sampling, split, summaries, vocab,
)


def test_keep_first_takes_the_first_copy(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(300)]
    kept = dedup.keep_first(spark.createDataFrame(rows, "row_id long, t string"), "t", ["row_id"])
    got = {r["row_id"] for r in kept.collect()}
    assert got == {i for i in range(300) if i % 3 == 0} | {1}


def test_keep_first_combines_groups_before_the_shuffle_and_sorts_no_text(spark):
    rows = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("t"))
    frame = dedup.keep_first(rows, "t", ["id"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_min" in plan and "Window" not in plan
    assert not [line for line in plan.splitlines() if " Sort [" in line and "t#" in line.split("Sort [")[1].split("]")[0]]


@pytest.mark.parametrize("digits", [1, 4])
def test_bucketed_rank_is_row_number(spark, digits):
    frame = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("s"))
    ranked = ranking.bucketed_rank(frame, ["s"], "id", 5, digits=digits).collect()
    import hashlib

    for stratum in ("a", "b"):
        ids = [r["id"] for r in frame.collect() if r["s"] == stratum]
        want = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|5".encode()).hexdigest(), i))
        got = sorted((r["rank"], r["id"]) for r in ranked if r["s"] == stratum)
        assert got == [(n, i) for n, i in enumerate(want, 1)]


def test_frequency_rank_with_ties_and_large_counts(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", rng.choice([2, 2, 2, 3, 1500, 1501, 90000]), rng.randrange(10**9) * 1000 + i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "token string, cnt long, first long")
    frame = frame.withColumn("first", F.col("first").cast("decimal(38,0)"))
    got = {r["token"]: r["rank"] for r in ranking.frequency_rank(frame, "token", slices=7).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}


def test_split_shares_and_stability(spark):
    frame = spark.range(1000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 333, "x").otherwise("y").alias("s")
    )
    first = {r["row_id"]: (r["s"], r["split"]) for r in split.stratified_split(frame, ["s"]).collect()}
    again = split.stratified_split(frame.repartition(7), ["s"])
    assert first == {r["row_id"]: (r["s"], r["split"]) for r in again.collect()}
    sizes = Counter(first.values())
    for stratum, n in (("x", 333), ("y", 667)):
        assert abs(sizes[(stratum, "train")] - 0.7 * n) <= 1
        assert abs(sizes[(stratum, "val")] - 0.15 * n) <= 1
        assert abs(sizes[(stratum, "test")] - 0.15 * n) <= 1


def test_split_of_tiny_strata(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "row_id long, s string")
    got = split.stratified_split(frame, ["s"]).collect()
    assert len(got) == 3 and all(r["split"] in split.SPLITS for r in got)


def test_split_does_not_shuffle_the_rows(spark):
    frame = spark.range(1000).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("string").alias("s")
    )
    plan = split.stratified_split(frame, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def _buckets(spark, sizes):
    rows = [(b * 10000 + i, b % 2, b // 2) for b, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, has_meta int, label int")


def test_balanced_exact_totals(spark):
    frame = _buckets(spark, [1, 700, 250, 52])
    for block in (7, 1000):
        got = sampling.balanced_exact(frame, block=block).collect()
        counts = Counter((r["has_meta"], r["label"]) for r in got)
        assert len(got) == 1003 and sorted(counts.values()) == [250, 251, 251, 251]
        copies = Counter(r["row_id"] for r in got)
        assert len({(r["row_id"], r["copy"]) for r in got}) == len(got)
        for b, n in enumerate([1, 700, 250, 52]):
            mine = [c for i, c in copies.items() if i // 10000 == b]
            assert max(mine) - min(mine) <= 1 and (len(mine) == n or max(mine) == 1)


def test_balanced_exact_with_one_bucket(spark):
    got = sampling.balanced_exact(_buckets(spark, [20])).collect()
    assert sorted(r["row_id"] for r in got) == list(range(20))


def test_balanced_draws(spark):
    frame = _buckets(spark, [3, 900, 400, 97])
    plain = sorted((r["draw"], r["row_id"]) for r in sampling.balanced_draws(frame).collect())
    mixed = sorted((r["draw"], r["row_id"]) for r in sampling.balanced_draws(frame, small=100).collect())
    assert plain == mixed and len(plain) == 1400
    shares = Counter(i // 10000 for _, i in plain)
    assert all(abs(shares[b] - 350) < 90 for b in range(4))
    assert sampling.balanced_draws(_buckets(spark, [20])).count() == 0


def test_bucket_sizes_show_empty_cells(spark):
    got = {(r["domain"], r["class"]): r["n"] for r in sampling.bucket_sizes(_buckets(spark, [4, 0, 2])).collect()}
    assert got == {("political", "fake"): 0, ("political", "real"): 0, ("health", "fake"): 4, ("health", "real"): 2}


def test_vocabulary_order_and_encoding(spark):
    rows = [(1, ["b", "a", "b", "c"]), (2, ["a", "d", "c"]), (3, [])]
    frame = spark.createDataFrame(rows, "row_id long, t array<string>")
    words = vocab.fit_token_vocab(frame, "t")
    assert {r["token"]: r["idx"] for r in words.collect()} == {"b": 2, "a": 3, "c": 4}
    for hot in (1, 100):
        got = {r[0]: r[1] for r in vocab.encode_tokens(frame, words, "t", 5, hot=hot).collect()}
        assert got == {1: [2, 3, 2, 4, 0], 2: [3, 1, 4, 0, 0], 3: [0, 0, 0, 0, 0]}
    small = frame.select("row_id", vocab.encode_inline(F.col("t"), {"a": 2, "b": 3}, 5).alias("x"))
    assert {r[0]: r[1] for r in small.collect()}[1] == [3, 2, 3, 1, 0]


def test_vocabulary_sees_train_only(spark):
    rows = [(1, "train", ["a", "a"]), (2, "test", ["z", "z"])]
    frame = spark.createDataFrame(rows, "row_id long, split string, t array<string>")
    words = vocab.fit_token_vocab(frame.filter("split = 'train'"), "t")
    assert [r["token"] for r in words.collect()] == ["a"]


def _claims(spark):
    rows = [
        (1, 1, "Ann", "Health, Tax", "tv", " Democrat", 1.0, 2.0, None, 0.0, 4.0),
        (2, 1, "ann ", "health", None, "martian", 3.0, 2.0, 0.0, 0.0, 4.0),
        (3, 1, "Bob", None, "TV", None, 5.0, 2.0, 0.0, 0.0, 4.0),
        (4, 0, "", "", "", "", 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    schema = (
        "row_id long, has_meta int, speaker string, subject string, context string, party string, "
        "barely_true_count double, false_count double, half_true_count double, "
        "mostly_true_count double, pants_fire_count double"
    )
    return spark.createDataFrame(rows, schema)


def test_metadata_fit_and_encode(spark):
    frame = _claims(spark)
    vocabs = metadata.fit_vocabs(frame, top_k={"speaker": 1, "subject": 100, "context": 80})
    got = {(r["field"], r["value"]): r["idx"] for r in vocabs.collect()}
    assert got == {
        ("speaker", "ann"): 1, ("subject", "health"): 1, ("subject", "unknown"): 2,
        ("context", "tv"): 1, ("context", "unknown"): 2,
    }
    scaler = metadata.fit_scaler(frame)
    row = scaler.first()
    assert row["mu_barely_true_count"] == 3.0 and row["sd_false_count"] == 1e-6
    meta = {r["row_id"]: r["meta"] for r in metadata.encode_metadata(frame, vocabs, scaler).collect()}
    assert meta[1][:7] == [0, 1, 0, 0, 0, 0, 0] and meta[2][:7] == [0, 0, 0, 0, 0, 0, 1]
    assert meta[1][12:] == [1, 1, 1] and meta[3][12:] == [0, 2, 1] and meta[4][12:] == [0, 2, 0]
    assert len(meta[1]) == 15


def test_metadata_rows_fall_back_to_all(spark):
    frame = _claims(spark)
    assert cleaning.metadata_rows(frame).count() == 3
    assert cleaning.metadata_rows(frame.withColumn("has_meta", F.lit(0))).count() == 4
    assert cleaning.metadata_rows(frame.drop("has_meta")).count() == 4


def test_class_weights(spark):
    frame = spark.createDataFrame([("fake",)] * 3 + [("real",)], "binary_label string")
    got = {r["binary_label"]: round(r["weight"], 4) for r in summaries.class_weights(frame).collect()}
    assert got == {"fake": 0.6667, "real": 2.0}


def test_union_reports_what_it_leaves_out(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    rows, left = cleaning.union_common(a, b)
    assert sorted(r["x"] for r in rows.collect()) == [1, 4] and left == {"first": ["y"], "second": ["z"]}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        cleaning.drop_missing(spark.range(1))


def test_alignment_gaps(spark):
    a, b = spark.range(5).toDF("row_id"), spark.range(3, 9).toDF("row_id")
    assert align.alignment_gaps(a, b).first().asDict() == {"only_first": 3, "only_second": 4}


def test_report_handles_absent_predictions(spark):
    rows = [(0, 0, 1), (1, 0, 1), (1, 0, 0)]
    frame = spark.createDataFrame(rows, "label int, pred int, has_meta int")
    got = {r["row"]: r.asDict() for r in metrics.classification_report(frame).collect()}
    assert got["real"]["precision"] == 0.0 and got["real"]["f1"] == 0.0 and got["real"]["support"] == 2
    assert got["fake"]["precision"] == 0.3333 and got["macro avg"]["f1"] == 0.25
    domains = {r["domain"]: r["n"] for r in metrics.domain_report(frame).collect()}
    assert domains == {"political": 2, "health": 1, "overall": 3}
    one = metrics.domain_report(frame.filter("has_meta = 1"))
    assert {r["domain"] for r in one.collect()} == {"political", "overall"}


def test_objective_without_concept_rows(spark):
    columns = ["logit0", "logit1", "class_weight"] + [
        f"{c}{x}" for c in ("em", "mo", "ne") for x in ("", "_logit0", "_logit1")
    ]
    frame = spark.range(3).select(
        F.lit(1).alias("label"),
        *[F.lit(1.0).alias(c) for c in columns],
        *[F.lit(0).alias(f"{c}_present") for c in ("em", "mo", "ne")],
    )
    row = metrics.objective(frame).first()
    assert row["aux_loss"] == 0 and row["cov_loss"] == 0 and row["train_loss"] == round(0.693147, 6)


def test_early_stop(spark):
    scores = [0.5, 0.6, 0.6, 0.5, 0.4, 0.3, 0.2, 0.9]
    frame = spark.createDataFrame(
        [("t", 1, i, s) for i, s in enumerate(scores, 1)], "tag string, seed int, epoch int, val_macro_f1 double"
    )
    assert runs.early_stop(frame).first().asDict() == {
        "tag": "t", "seed": 1, "best_epoch": 2, "stop_epoch": 7, "stopped_early": True,
    }
    short = runs.early_stop(frame.filter("epoch <= 4")).first()
    assert (short["best_epoch"], short["stop_epoch"], short["stopped_early"]) == (2, 4, False)


def test_pooling_long_equals_in_row(spark):
    rows = [(g, i, [float(g + i), float(-i)], int(i % 3 > 0 and g != 2)) for g in range(3) for i in range(6)]
    frame = spark.createDataFrame(rows, "g int, i int, v array<float>, m int")
    long = {r["g"]: r["pooled"] for r in pooling.masked_pool(frame, "g", "v", "m", 2).collect()}
    wide = frame.groupBy("g").agg(
        F.collect_list("v").alias("v"), F.collect_list("m").alias("m")
    ).select("g", pooling.masked_pool_rows(F.col("v"), F.col("m"), 2).alias("p"))
    for r in wide.collect():
        assert long[r["g"]] == pytest.approx(r["p"])
    assert long[2][:2] == [0.0, 0.0] and long[2][2] == pooling.LOWEST_FLOAT


def test_attention_over_groups_is_a_softmax(spark):
    import math

    rows = [("g", i, float(s), int(i != 2)) for i, s in enumerate([-700.5, 3.25, 99.0, 3.0, 2.75])]
    rows += [("none", 0, 1.0, 0)]
    frame = spark.createDataFrame(rows, "g string, i int, s double, m int")
    got = {(r["g"], r["i"]): r["alpha"] for r in pooling.masked_softmax(frame, ["g"], "s", "m").collect()}
    z = sum(math.exp(s - 3.25) for s in (3.25, 3.0, 2.75))
    assert got[("g", 3)] == pytest.approx(math.exp(-0.25) / z)
    assert got[("g", 2)] == 0.0 and got[("none", 0)] == 0.0 and got[("g", 0)] < 1e-200


def test_top_words_skip_placeholders_and_repeat(spark):
    rows = [(1, "em", w, a, r) for w, a, r in [
        ("<num>", 0.5, 1), ("big", 0.2, 1), ("big", 0.3, 1), (" big ", 0.1, 1), ("pad", 0.9, 0),
        ("x", 0.25, 1), ("zero", 0.0, 1), ("", 0.4, 1)]]
    frame = spark.createDataFrame(rows, "row_id int, channel string, word string, alpha double, real int")
    got = rationale.top_words_long(frame, ["row_id", "channel"], k=4).orderBy("nth").collect()
    assert [(r["word"], r["alpha"]) for r in got] == [("big", 0.3), ("x", 0.25)]


def test_top_subwords(spark):
    frame = spark.createDataFrame(
        [([0.5, 0.2, 0.1, 0.15, 0.05], ["[CLS]", "##ing", "may", "no", "pad"], [1, 1, 1, 1, 0], [1, 1, 1, 0, 1])],
        "a array<double>, p array<string>, r array<int>, m array<int>",
    )
    pairs = rationale.top_subwords(F.col("a"), F.col("p"), F.col("r"), F.col("m"))
    assert frame.select(rationale.format_top_tokens(pairs)).first()[0] == '"ing" (α=0.20), "may" (α=0.10)'


def test_round_robin_runs_dry(spark):
    rows = [(i, 1, 0, 0.1 * i, 0.0, 0.0) for i in range(5)] + [(10, 0, 1, 0.5, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "row_id long, has_meta int, label int, em double, mo double, ne double")
    got = curate.round_robin(frame, 4).orderBy("example").collect()
    assert [r["row_id"] for r in got] == [4, 10, 3, 2]


@pytest.mark.parametrize(
    "scores, expected",
    [
        ((0.1, 0.1, 0.1), "Verdict driven no concept channel"),
        ((0.5, 0.1, 0.1), "Verdict driven primarily by the affective framing the model attended to."),
        ((0.3, 0.5, 0.3), "Verdict driven by modal/hedging language, affective framing and negation cues."),
    ],
)
def test_human_summary(spark, scores, expected):
    frame = spark.createDataFrame([(*scores, 0, 0.876)], "em double, mo double, ne double, pred int, conf double")
    args = [F.col(c) for c in ("em", "mo", "ne", "pred", "conf")]
    text = frame.select(curate.human_summary(*args)).first()[0]
    assert text.startswith(expected) and text.endswith("→ predicted FAKE (confidence 0.88).")


def test_rationale_block(spark):
    frame = spark.createDataFrame([(0.74, 0.21, 0.61, 2.0, 0.0)], "em double, mo double, ne double, a double, b double")
    text = frame.select(rationale.rationale_text(*[F.col(c) for c in ("em", "mo", "ne", "a", "b")])).first()[0]
    lines = text.split("\n")
    assert lines[0] == "Step 1 [Emotion]:   score 0.74 → HIGH    — strong emotional language detected — common in manipulative claims"
    assert lines[4:6] == ["Verdict:     FAKE", "Confidence:  88.1%"]
    assert lines[7] == "Reasoning: This claim contains emotional language and negation patterns, which are common indicators of misleading content."
