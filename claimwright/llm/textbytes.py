"""Vectorised views of an Arrow column of texts: bytes, words and their hashes.

All functions work on the UTF-8 bytes of a whole column at once, without a Python
object per text. A null is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the working memory of a task.
CHUNK_BYTES = 4_000_000

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_in_word = np.zeros(256, bool)
_in_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row where that alone is longer."""
    _, offsets = joined(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end
        at = end


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and, for each text and the end, where it starts."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters of two bytes that start with C3."""
    out = _lower[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def ascii_folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z only."""
    return _lower[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)


def powers_to(n: int) -> np.ndarray:
    """At least the first ``n`` powers of an odd number, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 256), 0x9E3779B97F4A7C15, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


class Words:
    """The words of some texts: runs of letters, digits and non-ASCII bytes, folded by ``fold``.

    ``start`` and ``size`` place a word in ``data``, ``hash`` is 64 bits wide, and the
    words of text ``i`` are ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold=folded):
        self.data = fold(data)
        mask = _in_word[data]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        ends = mask.copy()
        ends[:-1] &= ~mask[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = mask[inner]
        ends[inner - 1] = mask[inner - 1]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            own = np.flatnonzero(mask)
            cuts = np.concatenate([[0], np.cumsum(self.size)[:-1]])
            place = np.arange(len(own)) - np.repeat(cuts, self.size)
            powers = powers_to(int(self.size.max()) + 1)
            values = (self.data[own].astype(np.uint64) + np.uint64(1)) * powers[place]
            self.hash = mix(np.add.reduceat(values, cuts) + self.size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def hashed_counts(codes: np.ndarray, offsets: np.ndarray, width: int, at: int, end: int) -> np.ndarray:
    """Counts of ``codes`` (below ``width``) in each text of ``at:end``."""
    out = np.empty((end - at, width), np.float32)
    for k in range(at, end):
        out[k - at] = np.bincount(codes[offsets[k] : offsets[k + 1]], minlength=width)
    return out


def root_scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots, scaled to length one; a row of zeros stays so."""
    roots = np.sqrt(counts)
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-9)
