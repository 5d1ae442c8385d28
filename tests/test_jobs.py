import pytest
from pyspark.sql import functions as F

from claimwright.operators import model
from claimwright.plans import pipelines


@pytest.fixture(scope="module")
def raw(spark):
    """120 short claims; some words go with a class, every fifth text is a copy."""
    def row(i):
        fake = i % 2 == 0
        words = "never shocking hoax terrible" if fake else "report maybe council budget"
        n = i - 10 if i % 5 == 4 and i > 10 else i
        text = f"Item{n} {words} number {chr(97 + n % 26)}{chr(97 + n // 26)}"
        return (i, "pants-fire" if fake else "true", text, "tax, health", f"Speaker {i % 7}",
                "republican" if i % 3 else None, 1.0, 0.0, None, 2.0, float(i % 4), "tv")

    schema = (
        "row_id long, label string, statement string, subject string, speaker string, party string, "
        "barely_true_count double, false_count double, half_true_count double, "
        "mostly_true_count double, pants_fire_count double, context string"
    )
    return spark.createDataFrame([row(i) for i in range(120)], schema)


@pytest.fixture(scope="module")
def headlines(spark):
    rows = [
        (i, f"FAKE: cure {chr(97 + i % 26)}{chr(97 + i // 26)} is not a hoax never" if i % 3 == 0
         else f"health report {chr(97 + i % 26)}{chr(97 + i // 26)} could help", "fake" if i % 3 == 0 else "real",
         "claim" if i % 2 else "news")
        for i in range(60)
    ] + [(100, "Hoax - Debunked", "fake", "news"), (101, "health report ba could help", "real", "claim")]
    return spark.createDataFrame(rows, "row_id long, statement string, label string, subset string")


@pytest.fixture(scope="module")
def corpus(raw, headlines):
    from claimwright.session import settle

    political = pipelines.political_corpus(raw)
    return settle(pipelines.merged_corpus(political, pipelines.health_corpus(headlines)))


def test_corpora(raw, headlines, corpus):
    assert pipelines.clean_claims(raw).count() < 120
    health = pipelines.health_corpus(headlines).collect()
    texts = [r["clean_statement"] for r in health]
    assert len(texts) == len(set(texts)) == 60  # the short row and the copy are gone
    assert all(not t.startswith("fake") for t in texts)
    assert health[0]["speaker"] == "" and health[0]["false_count"] == 0.0
    keys = corpus.groupBy("row_id").count().filter("count > 1")
    assert keys.count() == 0 and "subset" not in corpus.columns


def test_lengths_slice_tokens_and_tags_alike(raw):
    corpus = pipelines.political_corpus(raw)
    tables = pipelines.length_tables(corpus, [3, 128])
    rows = pipelines.evaluation_variants(tables).collect()
    for r in rows:
        assert len(r["truncated_tokens"]) == len(r["concept_tags"]) <= r["L"]
        assert len(r["sufficiency_tokens"]) + len(r["comprehensiveness_tokens"]) == len(r["concept_tags"])
    assert {r["L"] for r in rows} == {3, 128}


def test_train_score_report_and_cards(corpus):
    fitted, val_score, scored = pipelines.train_and_score(corpus, grid=(0.01,))
    assert val_score > 0.8
    record = pipelines.result_record(scored, val_score, tag="t", phase=3, seed=42).first()
    assert record["test_macro_f1"] > 0.8 and set(record["test_per_domain"]) <= {"political", "health"}
    assert record["tag"] == "t" and record["best_val_macro_f1"] == pytest.approx(val_score)
    cards = pipelines.curated_cards(scored, 3).orderBy("example").collect()
    assert [c["example"] for c in cards] == list(range(1, len(cards) + 1)) and cards
    assert "Reasoning trace:" in cards[0]["card"] and "top tokens:" in cards[0]["card"]
    test = pipelines.training_table(corpus).filter(F.col("split") == "test")
    drops = {r["variant"]: r["n"] for r in model.faithfulness(fitted, test).collect()}
    assert drops == {"sufficiency": test.count(), "comprehensiveness": test.count()}


def test_encoded_slots_follow_the_alignment(spark):
    rows = [(1, ["abcdefgh", "x"]), (2, []), (3, ["x"] * 200)]
    frame = spark.createDataFrame(rows, "row_id long, t array<string>")
    got = model.encode_slots(frame, model.hashed_projection(4), "t", batch_rows=2).collect()
    first = [(r["slot"], r["word"]) for r in got if r["row_id"] == 1]
    assert sorted(first) == [(1, 0), (2, 0), (3, 1)]
    vecs = {(r["row_id"], r["word"]): tuple(r["vec"]) for r in got}
    assert vecs[(1, 1)] == vecs[(3, 5)] and len(vecs[(1, 0)]) == 4
    assert sum(r["row_id"] == 3 for r in got) == 126


def test_text_leaks_are_found(spark):
    from claimwright.operators import split

    rows = [("train", "a"), ("test", "a"), ("train", "b"), ("train", "b"), ("val", None), ("test", "c")]
    assert split.text_leaks(spark.createDataFrame(rows, "split string, t string"), "t").count() == 1


def test_classifier_is_saved_and_loaded(spark, tmp_path):
    from pyspark.sql import functions as F

    from claimwright.operators import model

    rows = spark.range(60).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("has_meta"),
        F.array(F.when(F.col("id") % 2 == 0, "bad").otherwise("good"), F.lit("word")).alias("truncated_tokens"),
    )
    fitted, score = model.fit_classifier(rows, rows, meta=None, grid=(0.01,))
    model.save_classifier(fitted, str(tmp_path / "model"))
    again = model.score_rows(model.load_classifier(str(tmp_path / "model")), rows, meta=None)
    assert score == 1.0 and again.where("pred <> label").count() == 0
    assert again.select("logit1").collect() == model.score_rows(fitted, rows, meta=None).select("logit1").collect()
