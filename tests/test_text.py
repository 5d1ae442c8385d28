import pytest
from pyspark.sql import functions as F

from claimwright.functions import arrays as A, labels as L, text as T
from claimwright.operators import cleaning


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (lambda c: T.mark_allcaps(T.mask_urls(c)), "see http://x.co NOW",
         "see <<ALLCAPS> URL> <ALLCAPS> NOW"),
        (lambda c: T.mark_allcaps(T.mask_urls(c), mark_placeholders=False),
         "see http://x.co NOW", "see <URL> <ALLCAPS> NOW"),
        (T.mark_allcaps, "ÉAB AB_C AB", "ÉAB AB_C <ALLCAPS> AB"),
        (T.mask_numbers, "3.5 and 5g", "<NUM>.<NUM> and 5g"),
        (T.collapse_marks, "WHAT?! oh!!", "WHAT! oh!"),
        (T.collapse_punct, "well...ok,.", "well.ok."),
        (T.strip_verdict_prefix, "FAKE: FACT-CHECK: 5G causes it", "5G causes it"),
        (T.strip_verdict_prefix, "Real-time data helps", "time data helps"),
        (T.strip_verdict_prefix, "Hoaxes spread fast", "Hoaxes spread fast"),
        (T.collapse_space, " a   b\t\nc ", "a b c"),
        (T.nfkc, "ﬁne ① Ａ", "fine 1 A"),
        (T.nfkc, "plain", "plain"),
        (T.expand_contractions, "I can't, we're and don't", "I cannot, we are and do not"),
        (T.expand_contractions, "Won't they've", "Will not they have"),
        (T.expand_contractions, "it’s o'clock", "it is o'clock"),
        (T.name_emojis, "hi \U0001F600!", "hi  <EMO_grinning_face> !"),
        (T.strip_html, "<p>a &amp; b<!-- x --><script>var t='</p>';</script></p> 1 < 2",
         "a & b 1 < 2"),
        (T.strip_html, "a&nbsp;b &amplt; &copy &ndash;", "a\u00a0b &lt; © –"),
        (T.html_to_text, "a&nbsp;b &copy &ndash;", "a\u00a0b © –"),
        (T.html_to_text, "<p>a &amp; b<!-- x --><script>1<2</script></p>&#233;", "a & bé"),
    ],
)
def test_text_steps(one, fn, given, expected):
    assert one(fn, given) == expected


def test_profiles(spark):
    rows = spark.createDataFrame(
        [("<b>I can't</b> see http://x.co, 3 NEW!! \U0001F600",), ("plain words",)], "statement string"
    )
    out = [r[0] for r in cleaning.clean_political(rows).select("clean_statement").collect()]
    assert out == [
        "i cannot see <<allcaps> url> <num> <allcaps> new!  <emo_grinning_face> ", "plain words",
    ]
    rows = spark.createDataFrame([("HOAX!  BIG news, 3 cases!! it's.. ",)], "statement string")
    row = cleaning.normalize_health(cleaning.clean_health(rows)).first()
    assert row["clean_statement"] == "<allcaps> big news, <num> cases! it's.."
    assert row["normalized_text"] == "<allcaps> big news, <num> cases! it is.."
    assert cleaning.normalize_political(cleaning.clean_health(rows)).first()["normalized_text"] == (
        "<allcaps> big news, <num> cases! it is."
    )


def test_emoji_count(one):
    assert one(T.emoji_count, "a \U0001F600\U0001F600 b ☀") == 3


@pytest.mark.parametrize(
    "given, expected",
    [
        ("I don't know.", ["I", "do", "n't", "know", "."]),
        ("<num>.<num> <emo_x> a_b o'clock", ["<num>", ".", "<num>", "<emo_x>", "a_b", "o'clock"]),
        ("<<allcaps> url>", ["<", "<allcaps>", "url", ">"]),
    ],
)
def test_tokenize(one, given, expected):
    assert one(T.tokenize, given) == expected


def test_token_counters(spark):
    frame = spark.createDataFrame([(["No", "<num>", "!", "__x", "n't", "a"],)], "t array<string>")
    row = frame.select(*[c.alias(n) for n, c in T.token_counters(F.col("t")).items()]).first()
    assert row.asDict() == {
        "total_tokens": 6, "punctuation_tokens": 1, "negation_tokens": 2, "special_tokens": 1,
    }


@pytest.mark.parametrize(
    "items", [[], ["a"], ["it's", 'say "x"', "a,b", "[", "back\\slash", "é"], ["both'\""]]
)
def test_list_literal_round_trip(one, items):
    assert one(T.parse_list_literal, repr(items)) == items


def test_list_literal_rejects_other_text(one):
    assert one(T.parse_list_literal, "not a list") == []


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (L.binary_label, "half-true", "real"),
        (L.binary_label, "FALSE", "real"),
        (L.binary_label, "fake", "real"),
        (L.binary_label, "pants-fire", "fake"),
        (L.binary_label_lenient, " FALSE ", "fake"),
        (L.binary_label_lenient, "fake", "fake"),
        (L.binary_label_lenient, "half-true", "real"),
        (L.first_subject, None, "unknown"),
        (L.first_subject, "", "unknown"),
        (L.first_subject, "Health, Taxes", "health"),
        (L.party_slot, " Democrat", 2),
        (L.party_slot, "martian", 7),
        (L.party_slot, None, 7),
        (lambda c: L.encode_label(c, 0), "other", 0),
        (lambda c: L.encode_label(c, 1), "other", 1),
    ],
)
def test_labels(one, fn, given, expected):
    assert one(fn, given) == expected


@pytest.mark.parametrize(
    "fn, score, expected",
    [
        (L.score_level, 0.55, "HIGH"), (L.score_level, 0.30, "medium"),
        (L.score_level, 0.29, "low"), (L.score_band, 0.10, "low"),
        (L.score_band, 0.65, "very high"), (L.score_band, 1.0, "very high"),
        (L.score_band, 0.0, "negligible"),
    ],
)
def test_scores(one, fn, score, expected):
    assert one(fn, score, "x double") == expected


def test_mask_projection(spark):
    frame = spark.createDataFrame([([0, 1], [-1, 0, 1, 1, 2, -1])], "m array<int>, w array<int>")
    assert frame.select(A.project_mask(F.col("m"), F.col("w"))).first()[0] == [0, 0, 1, 1, 0, 0]


def test_subword_slots(spark):
    frame = spark.createDataFrame([(["abcdefgh", "x", "abcde"],)], "t array<string>")
    row = frame.select(
        A.subword_slots(F.col("t"), 8).alias("w"),
        A.attention_slots(F.col("t"), 8).alias("a"),
        A.subword_slots(F.col("t"), 5).alias("short"),
        A.words_kept(A.subword_slots(F.col("t"), 5)).alias("n"),
    ).first()
    assert row["w"] == [-1, 0, 0, 1, 2, 2, -1, -1]
    assert row["a"] == [1, 1, 1, 1, 1, 1, 1, 0]
    assert row["short"] == [-1, 0, 0, 1, -1]
    assert row["n"] == 2


def test_masked_softmax(spark):
    frame = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [1, 0, 1]), ([1.0, 2.0], [0, 0])], "s array<double>, m array<int>"
    )
    rows = [r[0] for r in frame.select(A.masked_softmax(F.col("s"), F.col("m"))).collect()]
    assert rows[0][1] == 0.0 and abs(sum(rows[0]) - 1) < 1e-12 and rows[0][2] > rows[0][0]
    assert rows[1] == [0.0, 0.0]
