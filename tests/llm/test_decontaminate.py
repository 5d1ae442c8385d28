import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from claimwright.llm import decontaminate as D


def folded(text):
    codes = D.fold_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return codes[codes > 0]


def brute(pattern, text):
    """Least edits of the pattern within the text, by the whole table."""
    row = np.zeros(len(text) + 1, np.int64)
    for i, p in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, len(text) + 1):
            new[j] = min(row[j - 1] + (p != text[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        how = rng.randrange(3)
        if how == 0:
            chars[at] = rng.choice("abcxyz")
        elif how == 1:
            chars.insert(at, rng.choice("abcxyz"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def words(rng, n):
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_finds_all_and_only_what_brute_force_finds():
    rng = random.Random(2)
    items = [(k, words(rng, rng.randint(3, 40))) for k in range(12)] + [(99, "short"), (98, "")]
    texts = []
    for _ in range(60):
        text = words(rng, rng.randint(0, 60))
        if rng.random() < 0.7:
            item = rng.choice(items[:12])[1]
            item = edited(rng, item, rng.randint(0, max(1, len(item) // 8)))
            at = rng.randint(0, len(text))
            text = text[:at] + item + text[at:]
        texts.append(text)
    probes = D.Probes(items)
    got = {(row, item): (s, e, d) for row, item, s, e, d, _ in D.scan(probes, pa.array(texts))}
    want = {}
    for row, text in enumerate(texts):
        for item, pattern in items:
            p = folded(pattern)
            if len(p) >= D.Q:
                d = brute(p, folded(text))
                if d <= D.budget(len(p)):
                    want[row, item] = d
    assert {k: v[2] for k, v in got.items()} == want and len(want) > 20
    for (row, item), (start, end, d) in got.items():
        assert brute(folded(dict(items)[item]), folded(texts[row][start:end])) == d


def test_layout_case_and_accents_do_not_hide_a_leak():
    probes = D.Probes([(1, "Étude complète, DES effets secondaires!")])
    text = "xx ÉTUDE\n complète des---EFFETS (secondaires) yy 😀"
    ((row, item, start, end, edits, _),) = D.scan(probes, pa.array([None, "", text]))
    assert (row, item, edits) == (2, 1, 0) and text[start:end] == "ÉTUDE\n complète des---EFFETS (secondaires"


def test_long_items_are_searched_by_windows():
    rng = random.Random(3)
    item = words(rng, 400)
    part = item[900 : 900 + 1200]
    assert {r for r, *_ in D.scan(D.Probes([(1, item)]), pa.array(["no " * 50, "a " + part + " b"]))} == {1}


@pytest.mark.parametrize("block", [1, 10**6])
def test_frames_and_blocks(spark, docs_of, block):
    rng = random.Random(4)
    items = [(k, words(rng, 20)) for k in range(5)] + [(None, words(rng, 20)), (7, None), (0, "tiny")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, items[0][1]), (1, items[0][1]), (2, None), (3, ""), (None, "z " + items[1][1]), (4, "q " * 50000 + items[2][1]), (5, "clean text here")]
    got = D.find_leaks(docs_of(rows), bench, block_chars=block).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got), key=repr) == sorted([(1, 0, 0), (1, 0, 0), (None, 1, 0), (4, 2, 0)], key=repr)
    assert D.find_leaks(docs_of([]), bench).count() == 0
    assert D.find_leaks(docs_of(rows), bench.limit(0)).count() == 0


def test_runs_of_one_letter_take_bounded_memory_and_time():
    probes = D.Probes([(1, "a" * 300), (2, "ab" * 150), (3, "a" * 299 + "b")])
    texts = pa.array(["a" * 300_000, "clean " * 50, "ab" * 50_000, "a" * 2_000 + "b"])
    tracemalloc.start()
    begun = time.perf_counter()
    got = {(row, item): (start, end, edits) for row, item, start, end, edits, _ in D.scan(probes, texts)}
    peak, spent = tracemalloc.get_traced_memory()[1], time.perf_counter() - begun
    tracemalloc.stop()
    assert got[0, 1] == (0, 300, 0) and got[2, 2] == (0, 300, 0) and got[3, 3] == (1701, 2001, 0) and got[0, 3][2] == 1
    assert {row for row, _ in got} == {0, 2, 3} and peak < 500e6 and spent < 120


def test_slices_count_like_one_pass(monkeypatch):
    rng = random.Random(9)
    items = [(k, words(rng, 30)) for k in range(8)] + [(20, "ab" * 60), (21, "a" * 90)]
    texts = [edited(rng, items[k % 10][1], k % 7) + " " + words(rng, 20) + "ab" * k for k in range(60)]
    probes = D.Probes(items)
    whole = list(D.scan(probes, pa.array(texts)))
    monkeypatch.setattr(D, "SLICE", 64)
    assert list(D.scan(probes, pa.array(texts))) == whole and len(whole) > 40


def test_short_items_are_found_as_written():
    probes = D.Probes([(1, "2+2=4"), (2, "\u4f60\u597d\u5417?"), (3, "What is"), (4, "(b)"), (5, "?!"), (6, "2+2=4")])
    texts = ["so 2 + 2 = 4.", "224 and 2+2=45", "x\uff0c\u4f60\u597d\u5417?", "\u4f60\u597d\u5417", "WHAT\n is", "whatis", "b (" + " " * 90 + "B )", "b", "", None]
    got = sorted((row, item, start, end) for row, item, start, end, *_ in D.scan(probes, pa.array(texts)))
    assert got == [(0, 1, 3, 12), (0, 6, 3, 12), (2, 2, 2, 5), (4, 3, 0, 8), (5, 3, 0, 6), (6, 4, 93, 94)]
