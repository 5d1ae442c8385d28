"""The trained operators: held-out accuracy, odd rows, and brute-force parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from claimwright.llm import language_id, quality, samples, textbytes, toxicity
from claimwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 .."), (None, "x"), (5, "word " * 60000), (6, "a"), (6, "a")]


@pytest.fixture(scope="module")
def scored(spark):
    return {name: QUERIES[name](spark, SF).toPandas() for name in ("op2_toxicity", "op6_language_id", "op7_quality")}


def labels(spark, name):
    return spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", name).toPandas()


def test_language_on_held_out_rows(spark, scored):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = scored["op6_language_id"].merge(truth, on="doc_id")
    assert len(both) == len(truth) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.9)])
def test_labels_on_held_out_rows(spark, scored, name, label, least):
    both = scored[name].merge(labels(spark, label), on="doc_id")
    held = both[both.held_out]
    assert scored[name].score.between(0, 1).all() and len(held) > 50
    assert (held.predicted == held[label]).mean() > least
    good, bad = held[held[label] == 1].score, held[held[label] == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.85


def test_output_codes():
    for n in (1, 2, 3, 4, 6, 7, 20):
        words = language_id.codewords(n)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert not apart or min(apart) >= (2 ** (n - 2) if 2 <= n <= 6 else words.shape[1] // 4)


def test_trigram_features_by_hand():
    (_, _, x), = language_id.features(pa.array([" ab ab ", "  ", None]))
    counts = {}
    data = textbytes.joined(pa.array([" ab ab "]))[0]
    for code in language_id.trigram_codes(data):
        counts[code] = counts.get(code, 0) + 1
    want = np.zeros(language_id.FEATURES)
    for code, n in counts.items():
        want[code] = np.sqrt(n)
    assert np.allclose(x[0], want / np.linalg.norm(want)) and not x[1:].any()


def test_language_of_odd_rows(spark, docs_of):
    training = docs_of([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)])
    rows = ODD + [(7, "the dog"), (8, "die katze"), (9, "中文")]
    got = sorted((tuple(r) for r in language_id.identify(docs_of(rows), training).collect()), key=repr)
    names = [(r[0], r[1]) for r in got]
    assert len(got) == len(rows) and (7, "en") in names and (8, "de") in names
    assert all((i, "und") in names for i in (1, 2, 3, 4)) and (9, "und") not in names
    assert language_id.identify(docs_of([]), training).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs_of(rows), docs_of([])).collect()} == {"und"}


def test_prior_is_close_to_the_share_of_positives():
    rng = np.random.default_rng(0)
    d = quality.STATS + quality.SHAPES
    draw = lambda n, at: rng.normal(at, 1, (n, d)).astype(np.float32)
    for share in (0.3, 0.8):
        mixed = np.vstack([draw(int(2000 * share), 0.4), draw(2000 - int(2000 * share), -0.4)])
        assert abs(quality.estimate_prior(draw(1000, 0.4), rng.permutation(mixed)) - share) < 0.08


def test_quality_statistics_by_hand():
    text = "Aa bb bb! 12\ncc"
    x = quality.statistics(*textbytes.joined(pa.array([text, ""])))[0]
    n = len(text)
    assert np.allclose(x[:10], [7 / n, 1 / n, 2 / n, 0, 3 / n, 1 / n, 0, 1 / n, 0, 0])
    assert np.isclose(x[10], 2 / 10) and x[11] == 0 and np.isclose(x[12], 1 / 5) and np.isclose(x[14], 4 / 5)


def test_quality_of_odd_rows(spark, docs_of):
    rows = ODD + [(100 + k, "Good plain words here. " * (k % 5 + 1)) for k in range(60)] + [(200 + k, "BAD!! " * (k % 5 + 5)) for k in range(30)]
    docs = docs_of(rows)
    trusted = docs.where("doc_id between 100 and 140").select("doc_id")
    got = quality.score_quality(docs, trusted, docs.select("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(docs, trusted.limit(0), docs.select("doc_id")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(docs_of([]), trusted, docs.select("doc_id")).count() == 0


def test_windows_cover_every_word_and_overlap():
    first = np.cumsum([0, 0, 1, 47, 48, 49, 84, 85, 500])
    text, start, size = toxicity.windows(first)
    for k, n in enumerate(np.diff(first)):
        own = [(s - first[k], s - first[k] + m) for t, s, m in zip(text, start, size) if t == k]
        covered = set().union(*(range(a, b) for a, b in own)) if own else set()
        assert covered == set(range(n))
        assert all(b > a2 for (_, b), (a2, _) in zip(own, own[1:]))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(np.array([3, 5, 9], np.uint64), np.zeros(4, np.float32), np.zeros(1 << toxicity.GRAM_BITS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = np.vstack([rng.normal(0, 1, (7, 6 * toxicity.HIDDEN)), np.zeros(6 * toxicity.HIDDEN)])
    ids, size = rng.integers(0, 7, (5, 6)), np.array([6, 6, 3, 1, 5])
    mask = np.arange(6) < size[:, None]
    ids = np.where(mask, ids, 7)
    label = np.array([0, 1, 1, 0, 1.0])
    loss, g, d_table = net.gradients(table, ids, mask, label)
    for values, grad in [(table, d_table), *((net.p[k], g[k]) for k in g)]:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in grad.shape)
            old, ends = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = old + step
                ends.append(net.gradients(table, ids, mask, label)[0])
            values[at] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - grad[at]) < 2e-3


def test_toxicity_of_odd_rows_and_long_texts(spark, docs_of):
    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choice("this that some more words go here and there".split()) for _ in range(n))
    bad = lambda n: plain(n) + " vilestuff" + rng.choice(["", "er", "ing"]) + " " + plain(n)
    rows = [(100 + k, plain(rng.randint(5, 80))) for k in range(150)] + [(300 + k, bad(rng.randint(2, 60))) for k in range(100)]
    test = [(600, plain(4000) + " vilestuffing " + plain(4000)), (601, plain(8000)), (602, "vilestuffed")]
    marks = spark.createDataFrame([(k, int(k >= 300), None) for k, _ in rows] + [(None, 1, None), (100, None, None)], "doc_id bigint, toxic int, score string")
    docs = docs_of(ODD + rows + test)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, marks).collect()}
    assert got[600] > 0.7 and got[602] > 0.7 and got[601] < 0.5
    assert got[1] == got[2] == got[3] == 0 and len(got) == len({i for i, _ in ODD + rows + test})
    assert toxicity.score_toxicity(docs_of([]), marks).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, marks.where("toxic = 1")).collect()} == {0.0}


def test_samples_keep_their_bound_under_repeated_ids(spark):
    rows = [(i, f"text {i} {k}", lang) for i in range(12) for k in range(5) for lang in ("en", "de" if i % 2 else "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    x, langs = language_id.training_rows(docs, "doc_id", "text", "lang", 8, 13)
    assert len(x) == len(langs) == 13 and max(map(langs.count, set(langs))) <= 8
    x, langs = language_id.training_rows(docs, "doc_id", "text", "lang", 100, 100)
    assert sorted(langs) == ["de"] * 6 + ["en"] * 12
    picked = spark.createDataFrame([(3, True), (5, False), (99, True)], "__id bigint, trusted boolean")
    got = samples.with_texts(docs, picked, "doc_id", "text").collect()
    assert sorted((r["__id"], r["trusted"], r["__text"]) for r in got) == [(3, True, "text 3 0"), (5, False, "text 5 0")]


def test_long_texts_are_learnt_in_pieces(spark):
    text = "".join(chr(97 + k * 26 // 80_000) for k in range(80_000))
    frame = spark.createDataFrame([(text,), ("short",), ("",)], "t string")
    long, short, empty = [r[0] for r in frame.select(toxicity.excerpt(F.col("t"), 6_000)).collect()]
    assert (short, empty) == ("short", "") and 5_900 < len(long) <= 6_000
    assert len(long.split(" ")) == 8 and long[0] == "a" and long[-1] == "z"


def test_decoding_equals_a_plain_loop():
    rng = np.random.default_rng(7)
    words = language_id.codewords(5)
    x = rng.random((40, language_id.FEATURES)).astype(np.float32)
    codes = language_id.Codes(list("abcde"), words, rng.normal(size=(language_id.FEATURES, words.shape[1])).astype(np.float32), rng.normal(size=words.shape[1]).astype(np.float32), rng.uniform(0.1, 3, words.shape[1]))
    best, share, lead = codes.decode(x)
    for row, b, s, d in zip(x, best, share, lead):
        margin = row @ codes.weights + codes.bias
        losses = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(codes.trust / codes.trust.sum(), word, margin)) for word in words]
        odds = np.exp((min(losses) - np.array(losses)) * words.shape[1])
        odds = np.sort(odds / odds.sum())
        assert b == int(np.argmin(losses)) and s == pytest.approx(odds[-1], abs=1e-3) and d == pytest.approx(odds[-1] - odds[-2], abs=1e-3)
