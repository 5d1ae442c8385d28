import random

from pyspark.sql import functions as F

from claimwright.functions import concepts as C

LEX = C.Lexicon(
    emotion=("really",), negation=("not", "without"), modality=("maybe", "about"),
    skip=("the", "about", "without"), boundaries=(",",),
)


def sequential(tokens):
    """The rule, told token by token: each cue walks right on its own."""
    cue_of = {"really": "EMOTION", "not": "NEGATION", "without": "NEGATION",
              "maybe": "MODALITY", "about": "MODALITY"}
    own = [cue_of.get(t) for t in tokens]
    scope, reach = [None] * len(tokens), {"NEGATION": 0, "MODALITY": 0}
    for i, cue in enumerate(own):
        if cue in (None, "EMOTION"):
            continue
        left = 3
        for j in range(i + 1, len(tokens)):
            if tokens[j] == "," or left == 0:
                break
            if tokens[j] in LEX.skip or tokens[j] == "-":
                continue
            left -= 1
            if scope[j] is None:
                scope[j] = cue
                reach[cue] += 1
    tags = [o or (f"{s}_SCOPE" if s else "O") for o, s in zip(own, scope)]
    return tags, reach


def tag(spark, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    codes = frame.withColumn("c", C.concept_codes(F.col("t"), LEX))
    return codes.select(
        "i", C.tags_from_codes(F.col("c")).alias("tags"),
        *[v.alias(k) for k, v in C.concept_counters(F.col("c")).items()],
    ).orderBy("i").collect()


def test_golden_row(spark):
    text = "he did not ever really say the big red car , maybe not true now"
    row = tag(spark, [text.split()])[0]
    assert row["tags"] == (
        "O O NEGATION NEGATION_SCOPE EMOTION NEGATION_SCOPE O O O O O "
        "MODALITY NEGATION MODALITY_SCOPE MODALITY_SCOPE"
    ).split()
    assert (row["emotion_tokens"], row["negation_cue_tokens"], row["negation_scope_tokens"]) == (1, 2, 3)
    assert (row["modality_cue_tokens"], row["modality_scope_tokens"]) == (1, 3)


def test_against_sequential_rule(spark):
    rng = random.Random(7)
    words = ["the", "not", "maybe", "about", "without", "really", ",", "-", "x", "y", "z", "w"]
    rows = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(400)]
    rows.append([rng.choice(words) for _ in range(1500)])  # several output chunks
    for given, row in zip(rows, tag(spark, rows)):
        tags, reach = sequential(given)
        assert row["tags"] == tags
        assert row["negation_scope_tokens"] == reach["NEGATION"]
        assert row["modality_scope_tokens"] == reach["MODALITY"]


def test_default_lexicon(spark):
    frame = spark.createDataFrame([(["They", "did", "n't", "say", "Really"],)], "t array<string>")
    assert frame.select(C.concept_tags(F.col("t"))).first()[0] == [
        "O", "O", "NEGATION", "NEGATION_SCOPE", "EMOTION",
    ]


def test_lexicon_sizes():
    lex = C.Lexicon()
    assert (len(set(lex.emotion)), len(set(lex.modality)), len(set(lex.negation))) == (169, 63, 53)
