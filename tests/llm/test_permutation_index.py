"""The permutation index against exact search over all pairs of query and row."""

import numpy as np
import pytest

from claimwright.llm import permutation_index as pi
from claimwright.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string, id int, shard int, block int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def exact(ids, vectors, k=20, every=20):
    out = {}
    for i, v in zip(ids, vectors):
        if i % every == 0 and i not in out:
            score = (vectors * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def results(frame_):
    out = {}
    for r in sorted(frame_.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, *_ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_recall_and_exact_scores_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got, want = results(QUERIES["op12_permutation_index"](spark, sf)), exact(ids, vectors)
    assert got.keys() == want.keys()
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 21))
        assert [(-s, i) for i, s, _ in found] == sorted((-s, i) for i, s, _ in found)
        assert all(s == pytest.approx(vectors[place[q]] @ vectors[place[i]], abs=1e-12) for i, s, _ in found)
    assert recall(got, want) >= 0.9


def test_several_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, (900, 1))
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(900) * 4 - 1200
    got = results(pi.neighbours(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, vectors)]), shard_rows=100, query_rows=50))
    want = exact(ids, vectors)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_small_tables_are_answered_whole(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 21):
        vectors = rng.normal(size=(n, 3)).astype(np.float32).astype(np.float64)
        ids = np.arange(n)
        got = results(pi.neighbours(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, vectors)])))
        want = {q: w for q, w in exact(ids, vectors).items() if w}
        assert {q: [i for i, *_ in f] for q, f in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_equal_vectors_go_by_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400, 0, -1)] + [(i, rng.normal(size=3).tolist()) for i in range(401, 801)]
    got = results(pi.neighbours(frame(spark, rows), shard_rows=150))
    assert [i for i, *_ in got[40]] == list(range(1, 21))
    assert [i for i, *_ in got[20]] == [*range(1, 20), 21]


def test_rows_that_take_no_part(spark):
    good = [(i, [1.0, float(i)]) for i in range(1, 61)]
    bad = [(80, None), (100, []), (120, [0.0, 0.0]), (140, [None, 1.0]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (None, [9.0, 9.0])]
    got = results(pi.neighbours(frame(spark, good + bad + [(60, [1.0, 60.0]), (7, [1.0, 7.0])])))
    assert set(got) == {20, 40, 60}
    assert not {i for f in got.values() for i, *_ in f} & {80, 100, 120, 140, 160, 180, None}
    assert all(i != q for q, f in got.items() for i, *_ in f)
    assert pi.neighbours(frame(spark, [])).count() == 0
    assert pi.neighbours(frame(spark, [(20, None)])).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        pi.neighbours(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_inverted_files_give_the_footrule():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 6))
    pivots = pi.Pivots.of(vectors[:10], float(np.linalg.norm(vectors, axis=1).max()))
    table = pi.places(pivots.order(vectors), 10)
    lists = pi.InvertedFiles(np.arange(50), vectors, table)
    order = pivots.order(vectors[3:4], True)[0]
    plain = [sum(abs(int(row[p]) - i) for i, p in enumerate(order[: lists.asked])) for row in table]
    assert lists.asked == 5 and lists.footrule(order).tolist() == plain
