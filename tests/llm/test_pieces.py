import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from claimwright.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "ing", " ", "  ", "\n", "é", "ción", "▁", "▁▁", "😀", "中", "x", "un", "believ", "able", ".", "!!", "&", "12", "\x00", "́"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def brute(text, v):
    """Whole-text search without window, words or cache; a raw space mark is unknown."""
    if not text:
        return []
    chars = [pieces.SPACE if c == " " else ("" if c == pieces.SPACE else c) for c in " " + text]
    raw = list(" " + text)
    n = len(chars)
    best = [(0.0, None, None)] + [None] * n
    for end in range(1, n + 1):
        options = []
        single = chars[end - 1] in v.pieces
        for start in range(max(0, end - v.longest), end):
            hit = v.pieces.get("".join(chars[start:end]))
            if hit:
                options.append((best[start][0] + hit[0], start, [hit[1]]))
        if not single:
            options.append((best[end - 1][0] + v.unknown, end - 1, [v.raw[b] for b in raw[end - 1].encode()]))
        top = max(s for s, _, _ in options)
        best[end] = next(o for o in options if o[0] == top)
    out, end = [], n
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for ids in reversed(out) for i in ids]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_words_and_cache_equal_the_whole_search(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text in texts(1, 400, 40) + ["internationalization", "a" * 500, "unbelievable" * 40, " lead", "trail "]:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == brute(text, vocabulary), repr(text)


def test_words_are_cut_only_where_no_piece_joins(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    rng = random.Random(8)
    parts = PARTS + ["œ", "œu", "v", "ł", "a", "ę", "si", "ě", "n", "ș", "ă", "c", "ż", "ő", "ű", "ъ", "ст", "²", "ª", "µ", "ı", "ğ", "’", "–", "…", "ال", "个", "一"]
    drawn = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    for text in drawn + ["une œuvre du cœur", "był został się ści", "před něco", "că și", "żółć őű ığdır"]:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == brute(text, vocabulary), repr(text)
    for piece in vocabulary.pieces:
        for a, b in zip(piece, piece[1:]):
            assert pieces.SPACE in (a, b) or (a in vocabulary.letters) == (b in vocabulary.letters), piece


def test_streaming_commits_early_and_equals_the_whole_search(vocabulary):
    for text in texts(2, 60, 60):
        text = text.replace(pieces.SPACE, "")
        if not text:
            continue
        for every in (1, 7, 64):
            stream = pieces.StreamingViterbi(vocabulary, every)
            got = stream.push((" " + text).replace(" ", pieces.SPACE))
            open_part = len(stream.chars)
            got += stream.close()
            assert got == brute(text, vocabulary)
            assert every > 1 or open_part <= 2 * vocabulary.longest


def test_window_stays_bounded_on_one_endless_word(vocabulary):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000))
    stream = pieces.StreamingViterbi(vocabulary)
    stream.push(word)
    assert stream.widest < 4 * pieces.COMMIT_EVERY


def test_round_trip_is_exact(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text in texts(3, 400, 30) + ["", " ", "  a", "▁", "a▁ b"]:
        assert pieces.decode_ids(np.frombuffer(encoder.encode(text), "<i4"), vocabulary) == text


def test_a_full_cache_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    encoder = pieces.Encoder(vocabulary)
    for text in texts(5, 50, 30):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == brute(text, vocabulary)
    assert len(encoder.words) <= 3


def test_frames(docs_of, vocabulary):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "é中"), (4, "word " * 40000)]
    coded = pieces.encode(docs_of(rows), MODEL)
    got = coded.collect()
    assert sorted(r["n_ids"] for r in got) == sorted(len(r["ids"]) for r in got)
    want = {t or "": brute(t or "", vocabulary) for _, t in rows[:5]}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
    back = sorted((r["text"] for r in pieces.decode(coded, MODEL).collect()))
    assert back == sorted(t or "" for _, t in rows)
    assert {tuple(r["ids"]) for r in got if r["doc_id"] in (1, 2, 3)} == {tuple(want["a b"]), ()}
    assert pieces.encode(docs_of([]), MODEL).count() == 0
