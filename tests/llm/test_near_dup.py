import random
import re

import numpy as np
import pyarrow as pa
import pytest

from claimwright.llm import components as cc, near_dup, textbytes, words


def words_of(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text):
    w = words_of(text)
    if not w:
        return None
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    parent, links, texts = list(range(n)), [0] * n, [set() for _ in rows]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                same = words_of(rows[i][1]) == words_of(rows[j][1])
                if same or common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                    links[i] += 1
                    links[j] += 1
                    if not same:
                        texts[i].add(tuple(words_of(rows[j][1])))
                        texts[j].add(tuple(words_of(rows[i][1])))
                    parent[root(i)] = root(j)
    out = []
    for i in range(n):
        own = [rows[j][0] for j in range(n) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], min(own) if own else None, links[i], len(texts[i])))
    return out


def corpus(seed, families=25, singles=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(text(rng.randint(1, 90))) for _ in range(singles)]
    for _ in range(families):
        base = text(rng.randint(4, 150))
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.7 else ", ").join(copy))
    rng.shuffle(out)
    return out


def result(frame):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [near_dup.BLOCK, 3])
def test_matches_brute_force(docs_of, block):
    rows = list(enumerate(corpus(1))) + [(900, None), (901, ""), (902, "..."), (None, "one two three"), (903, "One, two three!"), (5, "repeat me"), (5, "repeat me")]
    assert result(near_dup.near_duplicates(docs_of(rows), block=block)) == sorted(brute(rows), key=repr)


def test_a_large_group_of_distinct_near_copies(docs_of):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = result(near_dup.near_duplicates(docs_of(rows)))
    assert got == [(i, 0, 699, 699) for i in sorted(range(700), key=lambda i: repr((i, 0, 699, 699)))]


def test_depth_shortens_for_pairs_near_the_threshold(spark):
    schema = "u bigint, v bigint, depth int, alike double"
    sure = spark.createDataFrame([(k, 0, 6, 1.0) for k in range(1, 50)], schema)
    assert near_dup.choose_depth(sure, 0.9, 0.999) == 6
    near = spark.createDataFrame([(k, 0, 4 + k % 3, 0.8) for k in range(1, 50)], schema)
    assert near_dup.choose_depth(near, 0.8, 0.999) == 4


def test_links_across_task_borders():
    rows = [(0, bytes(12), k, bytes(near_dup.VALUES)) for k in range(10)]
    batch = lambda part: pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.binary(), pa.int64(), pa.binary()))], ["tree", "path", "vertex", "marks"]
    )
    run = near_dup._neighbours(4, 6, 0.5)
    whole = pa.Table.from_batches(list(run(iter([batch(rows[:4]), batch(rows[4:])])))).to_pylist()
    assert {r["u"] for r in whole if r["u"] is not None} == set(range(1, 10))
    assert [r["vertex"] for r in whole if r["tree"] is not None] == [0, 9]


def test_near_copies_among_many_long_texts_are_linked():
    rng = np.random.default_rng(7)
    n, words = 300, 120_000
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)

    def text(codes):
        out = np.full((len(codes), 5), 32, np.uint8)
        for k in range(4):
            out[:, k] = letters[(codes >> (4 * k)) & 15]
        return out.tobytes().decode()

    rows = []
    for i in range(n):
        codes = rng.integers(0, 1 << 16, words)
        rows.append((i, text(codes)))
        if i % 10 == 0:  # one word in 150 differs: a similarity of about 0.94
            codes[rng.integers(0, words, words // 150)] = rng.integers(0, 1 << 16, words // 150)
            rows.append((n + i, text(codes)))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], ["id", "text"])
    signed = pa.Table.from_batches(list(near_dup._sign(batch([r]) for r in rows))).to_pylist()
    size = 2 * near_dup.DEPTH
    tries = sorted((t, r["path"][t * size : (t + 1) * size], r["vertex"], r["marks"]) for r in signed for t in range(near_dup.TREES))
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
    sorted_rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tries), kinds)], ["tree", "path", "vertex", "marks"])
    run = near_dup._neighbours(near_dup.FLOOR, near_dup.DEPTH, near_dup.SIMILARITY - near_dup.SLACK)
    links = {frozenset((r["u"], r["v"])) for b in run(iter([sorted_rows])) for r in b.to_pylist() if r["u"] is not None}
    vertex = {r["id"]: r["vertex"] for r in signed}
    assert links == {frozenset((vertex[i], vertex[n + i])) for i in range(0, n, 10)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["vertex"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert cc.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_words_of_joined_texts_stay_apart():
    texts = pa.array(["ab", "cd", None, "", "É é x", "e"])
    w = textbytes.Words(*textbytes.joined(texts))
    assert w.first.tolist() == [0, 1, 2, 2, 2, 5, 6] and w.hash[2] == w.hash[3] and len(np.unique(w.hash)) == 5


def test_every_byte_of_a_word_counts():
    texts = pa.array(["abcdefghijklmnop", "abcdefghijklmnoq", "qbcdefghijklmnop"])
    assert len(np.unique(textbytes.Words(*textbytes.joined(texts)).hash)) == 3
    assert (textbytes.powers_to(300) % np.uint64(2) == 1).all()


def test_words_go_by_unicode_class():
    def same(*texts):
        w = words.Words(*textbytes.joined(pa.array(texts)))
        return [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]

    want, *others = same("one two three four", "One\u00a0two\u2014three\u3000four", "\u201cone\u201d two\u2026three\uff0cfour\u3002")
    assert len(want) == 4 and others == [want, want]
    for upper, lower in (("ŒUVRE ΑΒΓ ЖУК É", "œuvre αβγ жук é"),):
        a, b = same(upper, lower)
        assert a == b and len(a) == 4
    counts = lambda *t: [len(x) for x in same(*t)]
    # One word each: Han, kana, Thai letters with their marks; words: Hangul, Hindi with vowel signs.
    assert counts("中文字。", "ひらがな", "カタ", "กิน", "한국어 말", "हिन्दी भाषा", "abc中12文") == [3, 4, 2, 2, 2, 2, 4]
    # Marks without a letter, symbols and empty texts hold no words, also behind a text that ends in one.
    assert counts("a", "\u0301", "❤\ufe0f", None, "", "...", "\U00020000\U00030000") == [1, 0, 0, 0, 0, 0, 2]
    bad = np.frombuffer(b"ab \xff cd" + b"ef", np.uint8)
    assert words.Words(bad, np.array([0, 8, 10])).first.tolist() == [0, 2, 3]


def test_near_copies_in_scripts_without_spaces_and_with_typographic_marks(docs_of):
    rng = random.Random(5)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    plain = [f"w{k}" for k in range(60)]
    rows = [
        (1, han), (2, han[:100] + "\u3002" + han[101:]), (3, han[::-1]),
        (4, " ".join(plain)), (5, "\u00a0".join(plain)), (6, "\u2014".join([*plain[:59], "other"])),
        (7, "ΕΝΑ ΔΥΟ ΤΡΙΑ"), (8, "ενα δυο τρια"),
    ]
    assert result(near_dup.near_duplicates(docs_of(rows))) == [
        (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 0), (4, 4, 2, 1), (5, 4, 2, 1), (6, 4, 2, 1), (7, 7, 1, 0), (8, 7, 1, 0)]


def test_rarest_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64)]))
        counts = rng.integers(0, 4, near_dup.COUNTERS)
        common = len(np.intersect1d(a, b))
        if common and common >= 0.8 * (len(a) + len(b) - common):
            assert len(np.intersect1d(near_dup.rarest(a, counts, 0.8), near_dup.rarest(b, counts, 0.8)))


def test_pages_around_one_frame_part_without_losing_a_link(spark, docs_of):
    rng = random.Random(11)
    frame, rows = [f"f{k}" for k in range(130)], []
    for i in range(1500):
        own = [f"p{i}x{k}" for k in range(70)]
        rows.append((i, " ".join(frame + own)))
        if i % 15 == 0:
            own[rng.randrange(70)] = "changed"
            rows.append((10_000 + i, " ".join(frame + own)))
    got = {r[0]: r[1:] for r in result(near_dup.near_duplicates(docs_of(rows), block=64))}
    for i in range(1500):
        assert got[i] == ((i, 1, 1) if i % 15 == 0 else (i, 0, 0))
        assert i % 15 or got[10_000 + i] == (i, 1, 1)
    sets = [(int(k), 5, near_dup.Shingles(*textbytes.joined(pa.array([t]))).hash.tobytes()) for k, t in rows]
    parts = near_dup.split_groups(spark.createDataFrame(sets, "vertex bigint, root bigint, shingles binary"), 0.8).collect()
    assert {(r["vertex"], r["root"]) for r in parts} == {(k, k % 10_000) for k, _ in rows if k % 10_000 % 15 == 0}


def test_empty_table_and_long_texts(docs_of):
    assert near_dup.near_duplicates(docs_of([])).count() == 0
    long = " ".join(f"w{k}" for k in range(30000))
    assert result(near_dup.near_duplicates(docs_of([(1, long), (2, long + " more"), (3, "other text")]))) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 0)]
