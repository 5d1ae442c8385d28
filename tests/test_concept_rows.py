"""Tags by chunks and a join against the fold, and against a plain loop for any scope length."""

import random

import pytest
from pyspark.sql import functions as F

from claimwright.functions import concepts as C
from claimwright.operators import concept_rows as R
from test_concepts import LEX

WORDS = ["the", "not", "maybe", "about", "without", "really", ",", "-", "x", "y", "z", "w", "isn't", "'Not'"]


def texts(seed, n, longest=60):
    rng = random.Random(seed)
    return [[rng.choice(WORDS) for _ in range(rng.randint(0, longest))] for _ in range(n)]


def loop(tokens, steps):
    cue_of = {"really": "EMOTION", "not": "NEGATION", "without": "NEGATION", "maybe": "MODALITY", "about": "MODALITY"}
    live, tags = [], []  # (type, steps left), the earliest first
    for t in tokens:
        key = t.lower().strip("'`\"")
        cue = cue_of.get(key) or ("NEGATION" if key.endswith("n't") else None)
        kind = "boundary" if t == "," else "skip" if key in LEX.skip or t == "-" else "content"
        tags.append(cue or (f"{live[0][0]}_SCOPE" if live and kind == "content" else "O"))
        if kind == "boundary":
            live = []
        elif kind == "content":
            live = [(c, left - 1) for c, left in live if left > 1]
        if cue in ("NEGATION", "MODALITY"):
            live.append((cue, steps))
    return tags


def tags(spark, rows, steps, size):
    frame = spark.createDataFrame(list(enumerate(rows)), "row_id int, t array<string>")
    got = {}
    for r in R.tag_table_by_chunks(frame, "t", R.lexicon_table(spark, LEX), steps=steps, size=size).orderBy("row_id", "pos").collect():
        got.setdefault(r["row_id"], []).append(r["tag"])
        assert r["pos"] == len(got[r["row_id"]]) - 1
    return [got.get(i, []) for i in range(len(rows))]


@pytest.mark.parametrize(("steps", "size"), [(1, 1), (3, 2), (3, 7), (3, 256), (5, 4), (8, 3)])
def test_any_scope_and_chunk_size_equals_a_loop(spark, steps, size):
    rows = texts(steps * 31 + size, 60) + [[], ["not"] * 9, ["not"] + ["the"] * 20 + ["x"] * 12]
    assert tags(spark, rows, steps, size) == [loop(r, steps) for r in rows]


def test_tokens_are_not_sorted(spark):
    frame = spark.createDataFrame(list(enumerate(texts(2, 40, 600))), "row_id int, t array<string>")
    out = R.tag_table_by_chunks(frame, "t", R.lexicon_table(spark, LEX))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("Sort " not in plan or "token" not in plan[plan.index("Sort ") :].split("\n")[0])


def test_a_lexicon_of_any_size_is_routed_to_the_join(spark):
    many = tuple(f"term{i}" for i in range(30_000)) + LEX.emotion
    large = C.Lexicon(many, LEX.modality, LEX.negation, LEX.skip, LEX.boundaries)
    assert not large.inline and LEX.inline and not C.Lexicon(steps=4).inline
    with pytest.raises(ValueError, match="concept_rows"):
        C.concept_codes(F.col("t"), large)
    rows = texts(5, 30) + [["term29999", "not", "term7", "x"], []]
    frame = spark.createDataFrame([*enumerate(rows), (99, None)], "row_id int, t array<string>")
    got = {r["row_id"]: r["tags"] for r in R.with_tags(frame, "t", large, "tags").collect()}
    small = {r["row_id"]: r["tags"] for r in R.with_tags(frame, "t", LEX, "tags").collect()}
    assert {k: v for k, v in got.items() if k not in (30, 99)} == {k: v for k, v in small.items() if k not in (30, 99)}
    assert got[30] == ["EMOTION", "NEGATION", "EMOTION", "NEGATION_SCOPE"] and got[31] == [] and got[99] is None
