import hashlib
import random
import re

from claimwright.llm import exact_dedup


def brute(rows):
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        known = [x for x in norm[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(norm[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def result(frame):
    rows = frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_matches_brute_force_with_odd_rows(docs_of):
    rng = random.Random(5)
    texts = ["", None, " ", "\t\n", "a b", "a  b", "a\tb", "a\u00a0b", "é x", "é\x0bx", "long " * 30000]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "a b"), (None, "only null"), (3, "again"), (3, "again")]
    assert result(exact_dedup.mark_duplicates(docs_of(rows))) == sorted(brute(rows), key=repr)


def test_texts_that_share_length_and_prefix_stay_apart(docs_of):
    rows = [(1, "p" * 300 + "a"), (2, "p" * 300 + "b"), (3, "p" * 300 + "a")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.mark_duplicates(docs_of(rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_a_full_filter_changes_nothing(docs_of):
    rows = [(i, f"text {i % 50}") for i in range(200)]
    assert result(exact_dedup.mark_duplicates(docs_of(rows), blocks=1)) == sorted(brute(rows), key=repr)


def test_empty_table(docs_of):
    assert exact_dedup.mark_duplicates(docs_of([])).count() == 0
