"""Ranked search against a plain loop over all documents, and its stopping rule."""

import math
import re
from collections import Counter

import numpy as np

from claimwright.llm import ranked_search as rs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w, times in terms.items()
                if c[w]
            )
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def result(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id bigint, text string, rank string, score string").repartition(3)
    b = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, doc_id int, terms int")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rs.ranked_search(d, b, **more).collect()), key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(60)] + ["Éa", "é", "日本", "x_y", "A1"])
    share = 1 / np.arange(1, len(vocabulary) + 1)
    pick = lambda size: " ".join(rng.choice(vocabulary, size, p=share / share.sum()))
    docs = [(i, pick(int(rng.integers(0, 40)))) for i in range(n)]
    return docs, [(i, pick(int(rng.integers(0, 15)))) for i in range(12)]


def test_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(rs, "FIRST_DEPTH", 2)
    monkeypatch.setattr(rs, "BLOCK_DOCS", 50)
    docs, items = corpus(3, 400)
    docs += docs[:30] + [(None, "w1 w2 w2"), (1000, None), (1001, ""), (1002, " .,; "), (1003, "w3 " * 30_000 + "rare")]
    items += [(None, "w4 rare"), (3, "extra W1 w1"), (50, None), (51, "nowhere"), (52, "--")]
    assert result(spark, docs, items) == brute(docs, items)


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here" if i % 2 else "other text") for i in range(60, 0, -1)]
    got = result(spark, docs, [(1, "same")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 21, 2))


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, "a"), (2, "b")], [(1, "a")], k=1) == brute([(1, "a"), (2, "b")], [(1, "a")], 1)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_PAIRS", 10)
    docs, items = corpus(5, 80)
    assert result(spark, docs, items) == brute(docs, items)


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(4)
    docs, terms = 20_000, 3
    doc = np.repeat(np.arange(docs), terms)
    impact = (rng.pareto(1.5, docs * terms) * 1000).astype(np.int64) + 1
    lists = rs.ImpactLists(doc, np.tile(np.arange(terms), docs), impact, docs, terms)
    best = rs.Best(10)
    scored = rs.best_positions(lists, np.arange(terms), np.ones(terms, np.int64), np.zeros(docs, bool), np.arange(docs), best)
    total = impact.reshape(docs, terms).sum(axis=1)
    want = np.lexsort((np.arange(docs), -total))[:10]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == total[want].tolist()
    assert scored < docs / 10


def test_best_position_passes_rows_that_were_met_elsewhere():
    # Document 1 is first in one list and second in the other: both its places count as seen.
    doc, term = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1])
    lists = rs.ImpactLists(doc, term, np.array([5, 9, 9, 8]), 3, 2)
    best = rs.Best(1)
    scored = rs.best_positions(lists, np.array([0, 1]), np.array([1, 1]), np.zeros(3, bool), np.array([7, 8, 9]), best)
    assert best.id.tolist() == [8] and best.score.tolist() == [18] and scored <= 3
