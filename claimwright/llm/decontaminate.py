"""Benchmark decontamination by the q-gram lemma with diagonal bands.

A benchmark item of ``m`` characters that occurs in a text with at most ``k`` edits
shares at least ``m + 1 - q - k q`` of its character q-grams with the text, and the
shared ones lie on ``k + 1`` neighbouring diagonals. So shared q-grams are counted in
overlapping bands of ``2 (k + 1)`` diagonals, each diagonal in two bands, and only
bands that reach the bound are verified, by an alignment limited to the band.

Only letters and digits count, case folded, so layout and punctuation cost no edits.
Items with fewer than ``Q`` of them are found as they are written, but for case and white
space, between the borders of words.
Items longer than a window are searched as overlapping windows. The benchmark is the
query set: it goes to the tasks in blocks of bounded size, each block against all texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm import textbytes
from claimwright.llm.common import text_or_empty

Q = 8
ERROR_RATE = 0.1
WINDOW, STRIDE = 400, 200
BLOCK_CHARS = 2_000_000
BITS = 22
#: Shared q-grams that are counted at once; runs of one letter share very many.
SLICE = 1 << 21

_FAR = np.int64(1) << np.int64(56)
_UNIT = np.int64(1) << np.int64(32)
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its folded form, 0 for anything but letters and digits."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            if unicodedata.category(chr(c))[0] in "LN":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text starts among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return points, heads[offsets]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` codes from each place on."""
    h, width = codes.astype(np.uint64), 1
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # 1, 2, 4 codes joined: Q is 8
        h = h[:-width] * np.uint64(factor) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h


def budget(m: int, rate: float = ERROR_RATE) -> int:
    """Most edits for ``m`` characters; fewer where the lemma would bound nothing."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def written(text: str) -> str:
    """The text without white space, in lower case."""
    return "".join(text.lower().split())


class Probes:
    """The windows of one block of items, and an index of their q-grams."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        fold = fold_table()
        self.item, self.codes, self.edits, self.need = [], [], [], []
        self.short: dict[int, dict[int, list[tuple[object, str]]]] = {}  # by letters, then by hash
        for item, text in items:
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            folded = fold[points]
            folded = folded[folded > 0]
            if 0 < len(folded) < Q:
                key = int(gram_hashes(np.pad(folded, (0, Q - len(folded))))[0])
                self.short.setdefault(len(folded), {}).setdefault(key, []).append((item, written(text)))
            starts = [0] if len(folded) <= WINDOW else [*range(0, len(folded) - WINDOW, STRIDE), len(folded) - WINDOW]
            for start in starts:
                part = folded[start : start + WINDOW]
                if len(part) >= Q:
                    k = budget(len(part), rate)
                    self.item.append(item)
                    self.codes.append(part)
                    self.edits.append(k)
                    self.need.append(len(part) + 1 - Q - k * Q)
        self.edits, self.need = np.array(self.edits, np.int64), np.array(self.need, np.int64)
        grams = [gram_hashes(c) for c in self.codes]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        probe = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.probe, self.place = probe[order], place[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True


def candidates(probes: Probes, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows ``(text, probe, band)`` whose count of shared q-grams reaches the bound."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < Q or not len(probes.grams):
        return none
    h = gram_hashes(codes)
    at = np.flatnonzero(probes.seen[(h >> np.uint64(64 - BITS)).view(np.int64)])
    slot = np.minimum(np.searchsorted(probes.grams, h[at]), len(probes.grams) - 1)
    real = probes.grams[slot] == h[at]
    at, slot = at[real], slot[real]
    text = np.searchsorted(first, at, "right") - 1
    inside = at + Q <= first[text + 1]
    at, slot, text = at[inside], slot[inside], text[inside]
    many = probes.first[slot + 1] - probes.first[slot]
    if not many.sum():
        return none
    size = len(probes.codes)

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``text * size + probe`` and diagonals of the shared q-grams, so many at a time."""
        ends = np.cumsum(many)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], SLICE), "right")
        for low, high in zip(cuts, [*cuts[1:], len(many)]):
            here = many[low:high]
            run = np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here)
            entry = run + np.repeat(probes.first[slot[low:high]], here)
            own = np.repeat(text[low:high], here)
            yield own * size + probes.probe[entry], np.repeat(at[low:high], here) - first[own] - probes.place[entry]

    # A pair of text and probe with too few in all needs no bands.
    pairs, count = _total([_counts(pair) for pair, _ in slices()])
    pairs = pairs[count >= probes.need[pairs % size]]
    if not len(pairs):
        return none
    # Diagonals start at one less than the longest window before the text.
    low = -WINDOW - 1
    span = int(np.diff(first).max()) + WINDOW + 3
    counted = []
    for pair, diagonal in slices():
        spot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        enough = pairs[spot] == pair
        spot, pair, diagonal = spot[enough], pair[enough], diagonal[enough]
        key = spot * span + (diagonal // (probes.edits[pair % size] + 1) - low)
        counted.append(_counts(key))
    key, count = _total(counted)
    known, count = _total([(key, count), (key - 1, count)])
    pair, band = pairs[known // span], known % span + low
    reached = count >= probes.need[pair % size]
    return np.stack([pair // size, pair % size, band], 1)[reached]


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts; close keys are counted without a sort."""
    if not len(keys) or int(keys.max()) - int(keys.min()) > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    low = keys.min()
    counts = np.bincount(keys - low)
    known = np.flatnonzero(counts)
    return known + low, counts[known]


def _total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up, keys ascending."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    known, inverse = np.unique(keys, return_inverse=True)
    return known, np.bincount(inverse, counts).astype(np.int64)


def short_matches(
    probes: Probes, points: np.ndarray, offsets: np.ndarray, codes: np.ndarray, places: np.ndarray, first: np.ndarray
) -> Iterator[tuple[int, object, int, int, int]]:
    """``(text, item, start, end, letters)``: where each short item first stands in each text."""
    if not probes.short or not len(codes):
        return
    owner = np.searchsorted(first, np.arange(len(codes)), "right") - 1
    opens = np.ones(len(codes) + 1, bool)  # a word begins here: something else, or another text, before it
    opens[1:-1] = (np.diff(places) > 1) | (np.diff(owner) > 0)
    for m, by_hash in probes.short.items():
        n = len(codes) - m + 1
        at = np.flatnonzero(opens[:n] & opens[m:]) if n > 0 else np.zeros(0, np.int64)
        at = at[owner[at] == owner[at + m - 1]]
        keys = np.array(sorted(by_hash), np.uint64)
        done = set()
        for low in range(0, len(at), SLICE // Q):
            here = at[low : low + SLICE // Q]
            grams = np.zeros((len(here), Q), np.uint32)
            grams[:, :m] = codes[here[:, None] + np.arange(m)]
            h = gram_hashes(grams.ravel())[::Q] if len(here) else np.zeros(0, np.uint64)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for k in np.flatnonzero(keys[slot] == h):
                t, start, end = int(owner[here[k]]), int(places[here[k]]), int(places[here[k] + m - 1]) + 1
                for number, (item, letters) in enumerate(by_hash[int(h[k])]):
                    if (t, int(h[k]), number) in done:
                        continue
                    if _stands(points, int(offsets[t]), int(offsets[t + 1]), start, end, letters):
                        done.add((t, int(h[k]), number))
                        yield t, item, start - int(offsets[t]), end - int(offsets[t]), m


def _stands(points: np.ndarray, low: int, high: int, start: int, end: int, letters: str) -> bool:
    """Whether the text at ``start`` is written like the item, marks around its letters included."""
    fold = fold_table()
    lead = next((k for k, c in enumerate(letters) if fold[ord(c)]), 0)
    tail = next((k for k, c in enumerate(reversed(letters)) if fold[ord(c)]), 0)

    def around(step: int) -> str:
        """Enough written characters before the place (-1) or after it (1)."""
        reach = len(letters)
        while True:
            a, b = (max(low, start - reach), start) if step < 0 else (end, min(high, end + reach))
            found = written(points[a:b].tobytes().decode("utf-32-le", "replace"))
            if len(found) >= len(letters) or a == low or b == high:
                return found
            reach *= 2

    part = points[start:end].tobytes().decode("utf-32-le", "replace")
    inner = letters[lead : len(letters) - tail]
    if written(part) != inner:
        return False
    return (not lead or around(-1).endswith(letters[:lead])) and (not tail or around(1).startswith(letters[len(letters) - tail :]))


def align(pattern: np.ndarray, edits: int, texts: list[np.ndarray], lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of ``pattern`` within each text near diagonal ``low`` on, and the place.

    Rows run over the pattern, columns over the band; the match may start and end
    anywhere. Cost and start travel in one number, so the least cost takes its start along.
    """
    k, m = edits, len(pattern)
    width = 2 * (k + 1) + 2 * k
    shift = lows - k
    size = np.array([len(t) for t in texts])
    columns = np.arange(width)
    # Every text padded so that place j of the text is at j + pad.
    pad = int(max(0, -shift.min()) + 1)
    reach = int(max(size.max(), (shift + m + width).max())) + pad + 1
    padded = np.zeros((len(texts), reach), np.uint32)
    for row, t in enumerate(texts):
        padded[row, pad : pad + len(t)] = t
    j = shift[:, None] + columns
    cost = np.where((j >= 0) & (j <= size[:, None]), j, _FAR)
    ramp = columns * _UNIT
    rows = np.arange(len(texts))[:, None]
    for i in range(1, m + 1):
        j = shift[:, None] + i + columns
        same = padded[rows, np.clip(j - 1 + pad, 0, reach - 1)] == pattern[i - 1]
        step = cost + np.where(same, 0, _UNIT)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + _UNIT)
        step[(j < 1) & (j != 0) | (j > size[:, None])] = _FAR
        zero = j == 0
        if zero.any():
            step[zero] = i * _UNIT
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        cost[(j < 0) | (j > size[:, None])] = _FAR
    best = cost.argmin(1)
    least = cost[np.arange(len(texts)), best]
    return np.where(least >= _FAR >> 1, m + 1, least // _UNIT), least % _UNIT, shift + m + best


def scan(probes: Probes, texts: pa.Array, slots: int = 256) -> Iterator[tuple[int, object, int, int, int, int]]:
    """``(row, item, start, end, edits, characters)`` of the best match of each probe in each text."""
    fold = fold_table()
    for low, high in textbytes.chunks(texts):
        points, offsets = code_points(*textbytes.joined(texts.slice(low, high - low)))
        folded = fold[points]
        places = np.flatnonzero(folded)
        codes = folded[places]
        first = np.searchsorted(places, offsets)
        found = candidates(probes, codes, first)
        best: dict[tuple[int, int], tuple] = {}
        for probe in np.unique(found[:, 1]):
            own = found[found[:, 1] == probe]
            k = int(probes.edits[probe])
            sure: set[int] = set()  # texts in which it was found without an edit
            for at in range(0, len(own), slots):
                part = own[at : at + slots]
                # Bands ascend, so a later one holds no earlier match.
                part = part[[int(t) not in sure for t in part[:, 0]]] if sure else part
                if not len(part):
                    continue
                m = len(probes.codes[probe])
                starts = part[:, 2] * (k + 1)
                cut = np.maximum(starts - k - 1, 0)
                regions = [
                    codes[first[t] + c : min(first[t + 1], first[t] + max(0, s) + m + 4 * k + 4)]
                    for t, s, c in zip(part[:, 0], starts, cut)
                ]
                edits, begin, end = align(probes.codes[probe], k, regions, starts - cut)
                for t, c, e, b, z in zip(part[:, 0], cut, edits, begin, end):
                    if e <= k:
                        row = (int(e), int(places[first[t] + c + b] - offsets[t]), int(places[first[t] + c + z - 1] + 1 - offsets[t]))
                        if row < best.get((int(t), int(probe)), (k + 1,)):
                            best[int(t), int(probe)] = row
                        if e == 0:
                            sure.add(int(t))
        for t, item, start, end, m in short_matches(probes, points, offsets, codes, places, first):
            yield low + t, item, start, end, 0, m
        for (t, probe), (edits, start, end) in best.items():
            yield low + t, probes.item[probe], start, end, edits, len(probes.codes[probe])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size, blocks = [], 0, 0
    for row in benchmark.select(item_col, text_or_empty(F.col(text_col))).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= chars:
            yield block
            block, size, blocks = [], 0, blocks + 1
    if block or not blocks:  # an empty benchmark is one empty block
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item found in it: ``id_col, item_col, start, end, edits, similarity``.

    ``start`` and ``end`` are code points of the text, end exclusive; of an item's
    matches the one with the fewest edits, then the first, is returned. At most
    ``error_rate`` of the item's letters and digits are edited. Items with fewer than 8
    letters and digits are found where they stand between borders of words as they are written,
    but for case and white space; items without any are never found. Null texts count as empty.
    Repeated rows and items are found each; null ids pass through; extra columns are not
    read; an empty table on either side gives no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type.simpleString(), pa.string())
    if item_arrow == pa.string():
        benchmark = benchmark.withColumn(item_col, F.col(item_col).cast("string"))
    item_name = item_type.simpleString() if item_arrow != pa.string() else "string"
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        sent = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            probes = Probes(sent.value, error_rate)
            for batch in batches:
                best: dict = {}
                for row, item, start, end, edits, m in scan(probes, batch.column(1)):
                    now = (edits / m, start, end, edits, m)
                    if now < best.get((row, item), (2.0,)):
                        best[row, item] = now
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                        pa.array([k[1] for k in keys], item_arrow),
                        *(pa.array([best[k][i] for k in keys], pa.int64()) for i in (1, 2, 3)),
                        pa.array([1 - best[k][0] for k in keys], pa.float64()),
                    ],
                    ["id", "item", "start", "end", "edits", "similarity"],
                )

        found = rows.mapInArrow(search, f"id {id_type}, item {item_name}, start bigint, end bigint, edits bigint, similarity double")
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "similarity")
