"""Many models in one pass against separate fits, numeric gradients and an exact optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.operators import linear, model


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for i in range(n):
        label = int(rng.integers(2))
        share = np.linspace(1, 3 if label else 0.5, 12)
        tokens = [str(w) for w in rng.choice(words, int(rng.integers(0, 9)), p=share / share.sum())]
        rows.append((i, label, int(rng.integers(2)), tokens or None if i % 50 == 3 else tokens, [float(label + rng.normal()), float(rng.normal())], float(rng.integers(1, 4)), float(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "row_id long, label int, has_meta int, truncated_tokens array<string>, meta array<double>, wa double, wb double").repartition(5)


SETTINGS = [linear.Setting(f"{w}-{r}-{m}", r, w, m) for w in ("wa", "wb") for r in (0.01, 0.3) for m in (True, False)]


@pytest.fixture(scope="module")
def fitted(spark):
    train = table(spark).cache()
    return train, linear.fit_models(train, SETTINGS, iterations=60)


def dense(train, words):
    rows = train.orderBy("row_id").collect()
    x = np.array([[(r["truncated_tokens"] or []).count(w) for w in words] + [m * r["has_meta"] for m in r["meta"]] for r in rows], float)
    return x, np.array([r["label"] for r in rows], float), rows


def test_models_fitted_together_equal_models_fitted_alone(spark, fitted):
    train, together = fitted
    for k in (0, 3, 6):
        alone = linear.fit_models(train, [SETTINGS[k]], iterations=60)
        assert alone.words == together.words
        assert np.allclose(alone.coefficients[:, 0], together.coefficients[:, k], atol=1e-7)
        assert np.allclose(alone.intercepts[0], together.intercepts[k], atol=1e-7)


def test_the_optimum_has_no_gradient(fitted):
    train, models = fitted
    x, y, rows = dense(train, models.words)
    for k, s in enumerate(SETTINGS):
        w = np.array([r[s.weight] for r in rows])
        mean = w @ x / w.sum()
        spread = np.sqrt(w @ x**2 / w.sum() - mean**2)
        b = models.coefficients[:, k]
        if not s.use_meta:
            assert not b[-2:].any()
        pull = w * (1 / (1 + np.exp(-(x @ b + models.intercepts[k]))) - y) / w.sum()
        gradient = x.T @ pull / spread + s.reg * b * spread
        gradient = gradient if s.use_meta else gradient[:-2]
        assert abs(pull.sum()) < 2e-3 and np.abs(gradient).max() < 2e-3


def test_gradients_match_differences(spark, fitted):
    train, models = fitted
    stored = linear.feature_table(train, models.words, "truncated_tokens", "meta", tuple(SETTINGS))
    rng = np.random.default_rng(2)
    b, b0 = rng.normal(size=models.coefficients.shape), rng.normal(size=len(SETTINGS))
    loss, by_feature, by_intercept = linear.losses(stored, b, b0, 2)
    for at in (0, 5, len(b) - 1):
        step = np.zeros_like(b)
        step[at] = 1e-5
        up, down = (linear.losses(stored, b + sign * step, b0, 2)[0] for sign in (1, -1))
        assert np.allclose((up - down) / 2e-5, by_feature[at], rtol=1e-4, atol=1e-4)
    up, down = (linear.losses(stored, b, b0 + sign * 1e-5, 2)[0] for sign in (1, -1))
    assert np.allclose((up - down) / 2e-5, by_intercept, rtol=1e-4, atol=1e-4)


def test_margins_and_attributions_by_hand(spark, fitted):
    train, models = fitted
    x, _, rows = dense(train, models.words)
    got = {r["row_id"]: r["margins"] for r in linear.margins(models, train).collect()}
    want = x @ models.coefficients + models.intercepts
    assert all(np.allclose(got[r["row_id"]], want[k]) for k, r in enumerate(rows))
    one = models.pick(2)
    scored = model.score_rows(one, train)
    sums = {r["row_id"]: r["s"] for r in model.attributions(one, scored).groupBy("row_id").agg(F.sum("adds").alias("s")).collect()}
    n = len(models.words)
    for k, r in enumerate(scored.orderBy("row_id").collect()):
        text = x[k, :n] @ one.coefficients[:n, 0]
        assert sums.get(r["row_id"], 0.0) == pytest.approx(text if r["pred"] == 1 else -text, abs=1e-9)
        assert r["logit1"] - r["logit0"] == pytest.approx(want[k, 2]) and r["pred"] == int(want[k, 2] > 0)
        assert r["conf"] == pytest.approx(1 / (1 + np.exp(-abs(want[k, 2]))))


def test_tree_sums_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(linear, "FAN", 3)
    rows = [(k % 2, part, np.array([float(part), k], np.float64).tobytes()) for part in range(20) for k in range(2)]
    frame = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "slice int, part int, sums binary").repartition(6)
    got = linear._tree_sum(frame, 20)
    assert got[0].tolist() == [190.0, 0.0] and got[1].tolist() == [190.0, 20.0]


def test_degenerate_tables(spark):
    empty = table(spark).limit(0)
    none = linear.fit_models(empty, SETTINGS[:1])
    assert none.words == [] and not none.coefficients.any() and none.intercepts.tolist() == [0.0]
    one_class = table(spark).where("label = 1")
    m = linear.fit_models(one_class, SETTINGS[:1], iterations=5)
    assert all(r["margins"][0] > 0 for r in linear.margins(m, one_class).collect())
    rare = linear.fit_models(table(spark), SETTINGS[:1], most_words=3, meta=None, iterations=5)
    assert len(rare.words) == 3 == len(rare.coefficients)
