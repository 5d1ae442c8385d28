"""SentencePiece vocabularies: streaming Viterbi encoding, and decoding.

The best segmentation of a text into pieces is found from left to right. Only the last
positions within the longest piece are kept open; whenever the back pointers of all of
them lead through one boundary, everything before it is final and its ids are
committed. Memory is bounded by the open window, not by the text.

Two things make it fast. Where no piece of the vocabulary spans a place, all paths
converge there by themselves, so a text falls into words that can be encoded apart.
And a word met before is looked up in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm.common import text_or_empty

#: Fixed values of the vocabulary format: the mark of a space and the penalty of unknowns.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 300_000
COMMIT_EVERY = 64


class Vocabulary:
    """Pieces with ids and scores, single bytes, and what no piece spans."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[bytes | None] = []
        self.raw: dict[int, int] = {}
        self.pieces: dict[str, tuple[float, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (model.get_score(i), i)
        if len(self.raw) != 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        self.size = model.get_piece_size()
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        #: Whether texts may be cut before a space mark and at line breaks.
        self.splits_words = not any(b == SPACE and a != SPACE or "\n" in (a, b) for a, b in pairs)
        #: Latin letters and all that pieces join to them, directly or through others: no
        #: piece spans a place between one of these and any other character.
        self.letters = {chr(c) for c in range(256) if chr(c).isalpha()}
        joins = [(a, b) for a, b in pairs if SPACE not in (a, b)]
        while grown := {c for a, b in joins if (a in self.letters) != (b in self.letters) for c in (a, b)} - self.letters:
            self.letters |= grown
        self.byte_of = {i: bytes([b]) for b, i in self.raw.items()}
        self.text_of = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.pieces.items()}


class StreamingViterbi:
    """Encodes characters as they come; ``push`` and ``close`` return the ids that became final.

    ``literal`` marks characters that stand for themselves even if they look like the
    mark of a space. Among equal scores the segmentation with the longest last piece wins,
    at every place.
    """

    def __init__(self, vocabulary: Vocabulary, commit_every: int = COMMIT_EVERY):
        self.v, self.every = vocabulary, commit_every
        self.chars: list[str] = []  # from the last committed boundary on
        self.score, self.back, self.ids = [0.0], [0], [()]
        self.widest = 0

    def push(self, chars: str, literal: bool = False) -> list[int]:
        out: list[int] = []
        for c in chars:
            self._step(c, literal)
            if len(self.chars) >= self.every and len(self.chars) % self.every == 0:
                out += self._commit()
        return out

    def _step(self, c: str, literal: bool) -> None:
        v, chars, score = self.v, self.chars, self.score
        chars.append("" if literal else c)
        n = len(chars)
        best, back, own, known = -np.inf, n - 1, None, False
        if not literal:
            # From the longest piece that may end here to the shortest.
            for start in range(max(0, n - v.longest), n):
                hit = v.pieces.get("".join(chars[start:n])) if "" not in chars[start:n] else None
                if hit is not None:
                    known = start == n - 1
                    if score[start] + hit[0] > best:
                        best, back, own = score[start] + hit[0], start, (hit[1],)
        if not known and score[n - 1] + v.unknown > best:
            best, back, own = score[n - 1] + v.unknown, n - 1, tuple(v.raw[b] for b in c.encode())
        score.append(best)
        self.back.append(back)
        self.ids.append(own)
        self.widest = max(self.widest, n)

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.ids[end])
            end = self.back[end]
        return [i for ids in reversed(out) for i in ids]

    def _commit(self) -> list[int]:
        n = len(self.chars)
        alive = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(self.back[last])
        cut = alive.pop()
        if cut == 0:
            return []
        out = self._path(cut)
        self.chars = self.chars[cut:]
        base = self.score[cut]
        self.score = [s - base for s in self.score[cut:]]
        self.back = [0] + [b - cut if b >= cut else -1 for b in self.back[cut + 1 :]]
        self.ids = self.ids[cut:]
        return out

    def close(self) -> list[int]:
        out = self._path(len(self.chars))
        self.__init__(self.v, self.every)
        return out




class Encoder:
    """Whole texts to ids as little-endian 32-bit integers, with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        if vocabulary.splits_words:
            letters = "".join(map(re.escape, sorted(vocabulary.letters - {" ", "\n"})))
            self._split = re.compile(rf" *[{letters}]+| *[^ \n{letters}]+|\n| +").findall
        else:
            self._split = lambda text: [text]

    def _word(self, word: str) -> bytes:
        if len(word) <= 2 * COMMIT_EVERY and SPACE not in word:
            return np.array(self._short(word.replace(" ", SPACE)), "<i4").tobytes()
        stream, ids = StreamingViterbi(self.v), []
        for part in re.split(f"({SPACE})", word):
            if part == SPACE:
                ids += stream.push(part, literal=True)
            else:
                ids += stream.push(part.replace(" ", SPACE))
        return np.array(ids + stream.close(), "<i4").tobytes()

    def _short(self, word: str) -> list[int]:
        """The same search for a word that fits the window: no commit falls due before its end."""
        pieces, prefixes, unknown, n = self.v.pieces, self.v.prefixes, self.v.unknown, len(word)
        score, back, own = [-np.inf] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for start in range(n):
            at, known = score[start], False
            for end in range(start + 1, n + 1):
                part = word[start:end]
                if part not in prefixes:
                    break
                hit = pieces.get(part)
                if hit is not None:
                    known = known or end == start + 1
                    if at + hit[0] > score[end]:
                        score[end], back[end], own[end] = at + hit[0], start, hit[1]
            if not known and at + unknown > score[start + 1]:
                score[start + 1], back[start + 1], own[start + 1] = at + unknown, start, None
        ids, end = [], n
        while end:
            if own[end] is not None:
                ids.append(own[end])
            else:
                ids += [self.v.raw[b] for b in reversed(word[back[end] : end].encode())]
            end = back[end]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` after one space; an empty text has none."""
        if not text:
            return b""
        words = self._split(" " + text)
        known = self.words
        learned: dict[str, bytes] = {}
        for w in set(words):
            if w not in known:
                learned[w] = self._word(w)
        if not learned:
            return b"".join(map(known.__getitem__, words))
        if len(known) + len(learned) <= CACHED_WORDS:
            known.update((w, x) for w, x in learned.items() if len(w) <= 64)
        return b"".join([learned[w] if w in learned else known[w] for w in words])


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text behind ids: pieces joined, bytes put together, the first space taken off.

    Ids of control pieces and ids outside the vocabulary stand for nothing; bytes that
    are no UTF-8 become the replacement character.
    """
    text, byte = vocabulary.text_of, vocabulary.byte_of
    joined = b"".join([text[i] if i in text else byte.get(i, b"") for i in ids.tolist()])
    return joined.decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def _coded(part: pa.RecordBatch, encoder: Encoder, decoded: bool) -> pa.RecordBatch:
    coded = [encoder.encode(t.as_py()) for t in part.column(1)]
    sizes = np.array([len(c) // 4 for c in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), "<i4")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
    columns = [part.column(0), pa.array(sizes), lists, pa.array([zlib.crc32(c) for c in coded], pa.int64())]
    names = ["id", "n_ids", "ids", "ids_crc32"]
    if decoded:
        texts = (decode_ids(np.frombuffer(c, "<i4"), encoder.v) for c in coded)
        columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()))
        names.append("decoded_sha256")
    return pa.RecordBatch.from_arrays(columns, names)


def _encode(docs: DataFrame, model: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                yield _coded(batch.slice(low, 200), encoder, decoded)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    schema = f"id {id_type}, n_ids bigint, ids array<int>, ids_crc32 bigint" + ", decoded_sha256 string" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_ids, ids, ids_crc32``.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian 32-bit integers. Null
    and empty texts have no ids. Texts of any length are encoded whole. Null ids and
    repeated rows pass through; extra columns are not read; an empty table gives no rows.
    ``model`` is a path that each executor can open.
    """
    return _encode(docs, model, id_col, text_col, False)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: ``id_col, text``. Null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(model).v
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [
                    "" if not x.is_valid else decode_ids(x.values.to_numpy(zero_copy_only=False), vocabulary)
                    for x in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    id_type = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``decoded_sha256``, the hash of the text that the ids decode to.

    One pass does both, so a task needs one Python worker and one copy of the vocabulary.
    """
    return _encode(docs, model, id_col, text_col, True)
