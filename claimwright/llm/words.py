"""Words of texts by Unicode class, without a Python object per text.

A word is a run of letters and digits (classes L and N) with the marks (class M) that
follow them, case folded by ``decontaminate.fold_table``; everything else ends a word. In
scripts written without spaces each letter, with its marks, is a word of its own.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from claimwright.llm import textbytes
from claimwright.llm.decontaminate import code_points, fold_table

#: Thai and Lao, Myanmar, Khmer, Tai scripts, kana, bopomofo, Han, Yi, Tangut and others.
ALONE = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
_END, _LETTER, _ALONE, _MARK = range(4)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its folded form and its part in a word."""
    global _tables
    if _tables is None:
        fold = fold_table().copy()
        # The folding of decontamination ends before the third ideographic plane.
        for c in range(0x30000, 0x40000):
            if unicodedata.category(chr(c))[0] in "LN":
                fold[c] = c
        part = np.where(fold > 0, _LETTER, _END).astype(np.uint8)
        for low, high in ALONE:
            part[low : high + 1][part[low : high + 1] == _LETTER] = _ALONE
        for c in (*range(0x20000), *range(0xE0100, 0xE01F0)):
            if unicodedata.category(chr(c))[0] == "M":
                fold[c], part[c] = c, _MARK
        _tables = fold, part
    return _tables


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each starts; bytes that are no UTF-8 are replaced."""
    try:
        data.tobytes().decode()
        return code_points(data, offsets)
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


class Words:
    """``hash`` of each word, 64 bits wide; the words of text ``i`` are ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        fold, kinds = tables()
        points, offsets = points_of(data, offsets)
        part = kinds[points]
        starts = np.zeros(len(points), bool)
        starts[offsets[offsets < len(points)]] = True
        mark = part == _MARK
        if mark.any():
            # A mark belongs to the letter before it; without one in its text it ends a word.
            base = np.maximum.accumulate(np.where(mark & ~starts, 0, np.arange(len(points))))
            part = np.where(mark, np.where(part[base] == _MARK, _END, part[base]), part)
        inside = part != _END
        before = np.concatenate([[_END], part[:-1]]) if len(part) else part
        begins = inside & (starts | (before != part) | ((part == _ALONE) & ~mark))
        own = np.flatnonzero(inside)
        self.start = np.flatnonzero(begins)
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            cuts = np.searchsorted(own, self.start)
            size = np.diff(np.append(cuts, len(own)))
            place = np.arange(len(own)) - np.repeat(cuts, size)
            powers = textbytes.powers_to(int(size.max()) + 1)
            values = (fold[points[own]].astype(np.uint64) + np.uint64(1)) * powers[place]
            self.hash = textbytes.mix(np.add.reduceat(values, cuts) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
