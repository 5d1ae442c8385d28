"""Whitening against plain integer and floating-point arithmetic."""

import math

import numpy as np
import pytest

from claimwright.llm import whitening
from claimwright.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, component string, n string, deviation string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", None) for i, v in rows], SCHEMA)


def test_block_sums_equal_plain_integers():
    rng = np.random.default_rng(1)
    for top in (0, 1, 5, 200, 2**40):
        x = rng.integers(-top, top + 1, (131, 5)) + 1_000_000
        x[:, 2] = 7
        sums, cross = whitening.block_sums(x)
        big = x.astype(object)
        assert (sums == big.sum(axis=0)).all()
        assert (cross == big.T.dot(big)).all()


def test_deviation_beyond_a_long_is_told_apart():
    near = math.isqrt(2**63)
    rows = np.array([[3, 4], [near, 0], [near + 1, 0], [2**40, 2**40]], np.int64)
    values, fits = whitening.squared_lengths(rows)
    assert fits.tolist() == [True, True, False, False]
    assert values[:2].tolist() == [25, near**2]
    again, same = whitening.squared_lengths(rows.astype(object))
    assert same.tolist() == fits.tolist() and again[:2].tolist() == [25, near**2]


def brute(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    return [i for i, _ in kept], x, n, sums, centred


def test_whitened_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(0, 1, 6) * [9, 5, 3, 2, 1, 0.5]]) for k in range(300)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [float("nan")] * 6), (902, [None] + [0.0] * 5), (903, []), (904, [float("inf")] * 6)]
    got = whitening.whiten(frame(spark, rows), components=4).collect()
    ids, x, n, sums, centred = brute(rows)
    assert len(got) == 302 * 4 and {r["n"] for r in got} == {302}
    want = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip(ids, x)}
    assert all(r["deviation"] == want[r["vec_id"]] for r in got)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    for c in range(4):
        plain = centred @ axes[:, c] / np.sqrt(values[c])
        own = np.array([by_id[i][c + 1] for i in ids])
        assert np.allclose(np.abs(own), np.abs(plain), atol=1e-8)
        assert abs(abs(own @ plain) / n - 1) < 1e-8


def test_little_or_no_spread(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(k, [0.5, 0.25]) for k in range(5)])).count() == 0
    one = whitening.whiten(frame(spark, [(k, [float(k), 1.0, 2.0 * k]) for k in range(9)])).collect()
    assert {r["component"] for r in one} == {1} and len(one) == 9
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).count()


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x, n, sums, centred = brute(rows)
    got = QUERIES["op13_whitening"](spark, sf).collect()
    assert len(got) == len(ids) * 32
    want = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip(ids, x)}
    assert all(r["deviation"] == want[r["vec_id"]] and r["identity_error"] < 1e-4 for r in got)
