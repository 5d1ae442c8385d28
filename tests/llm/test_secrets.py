import random
import re
import time

from claimwright.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.BASE_KINDS.index(s[0])))


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(7)
    parts = ["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "apı_key", "\u017fecret", "=", ":", " ", '"', "'", "AKIA",
             "ABCDEFGHIJKL", "AKIAAKIA0123456789", "deadbeef" * 4, "0" * 31, "é", "abcdefgh", "x", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = [s[:3] for s in secrets.ordered(secrets.base_spans(text))]
        assert got == brute(text), text


def test_ownership_decides_wide_spans_and_keeps_base_ones(docs_of):
    key = "ghp_" + "aB3dE5" * 6
    own = "xoxb-1234567890-abcdef"
    rows = [(1, f"use {key} here", "en", "a"), (2, f"{key}", "en", "b"), (3, f"my {own} é password = hunter2hunter2", "en", "a"),
            (4, "password: hunter2hunter2", "en", "b"), (5, None, "en", None), (6, "", "en", "a")]
    got = {r["doc_id"]: r["found"] for r in secrets.scan_secrets(docs_of(rows)).collect()}
    assert got[1] == [] and got[2] == [] and got[5] == [] and got[6] == []
    assert [(s["kind"], s["live"]) for s in got[3]] == [("slack", True), ("assign", False)]
    assert [(s["kind"], s["owners"], s["repos"]) for s in got[4]] == [("assign", 2, 2)]


def test_repeated_rows_nulls_long_texts_and_empty_table(docs_of):
    long = "word " * 40000 + "token=abcdefgh1"
    rows = [(1, long), (1, long), (None, long)]
    got = secrets.scan_secrets(docs_of(rows)).collect()
    assert len(got) == 3 and all(len(r["found"]) == 1 for r in got)
    assert secrets.scan_secrets(docs_of([])).count() == 0


def test_wide_spans_match_a_plain_search():
    rng = random.Random(9)
    patterns = [(k, re.compile(p)) for k, p, _ in secrets.WIDE if k != "jwt"]
    jwt = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
    parts = ["eyJ", "eyJhbGciOi", ".", "eyJzdWIiOiI", "sig_-9", " ", "x", "ghp_" + "aB3dE5" * 6, "xoxb-1234567890", "AIza" + "aB3_-" * 7,
             "http://u:p@h", "token=abcdefgh", "aB3dE5fG7hJ9kL1mN3pQ5r", "deadbeef" * 4, "é"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        base = secrets.base_spans(text)
        want = []
        for kind, pattern in [*patterns[:3], ("jwt", jwt), *patterns[3:], ("entropy", secrets._entropy)]:
            for m in pattern.finditer(text):
                clear = all(m.end() <= s[1] or s[2] <= m.start() for s in (*base, *want))
                if clear and (kind != "entropy" or secrets._random_looking(m[0])):
                    want.append((kind, m.start(), m.end(), m[0]))
        assert secrets.wide_spans(text, base) == want, text


def test_long_texts_full_of_candidates_take_linear_time():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = " ".join("".join(rng.choice(letters) for _ in range(30)) for _ in range(33_000))
    for text in (words, "eyJ" * 340_000, "eyJaaaaaaaa." * 85_000, "token=abcdefgh " * 68_000, "http://a:b@" * 90_000):
        start = time.process_time()
        secrets.wide_spans(text, secrets.base_spans(text))
        assert time.process_time() - start < 20


def test_owners_and_repositories_are_counted_like_a_plain_count(docs_of):
    rng = random.Random(4)
    values = [f"hunter{k}hunter{k}" for k in range(6)]
    rows = [(i, " ".join(f"password={rng.choice(values)}" for _ in range(rng.randint(0, 3))), "en", rng.choice(["a", "b", "c", None])) for i in range(120)]
    rows += rows[:20]
    seen = {v: ({s for i, t, _, s in rows if v in t}, {i for i, t, _, s in rows if v in t}) for v in values}
    found = secrets.scan_secrets(docs_of(rows)).collect()
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        for span in r["found"]:
            value = texts[r["doc_id"]][span["start"] : span["end"]].split("=")[1]
            owners, repos = seen[value]
            assert span["repos"] == len(repos) and span["owners"] in (len(owners), len(owners - {None}))
