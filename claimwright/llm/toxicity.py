"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words, all of them. Each word enters as a word
vector (for words of the training vocabulary) and a character vector (the mean over its
hashed character n-grams), with the log odds of both as further inputs. The network
runs over a window in both directions, attention pools its states to one logit, and a
text's score is that of its worst window. Training is plain numpy with hand-written
gradients, on the worst window of each training text.

Whatever depends on a word alone is computed once per distinct word of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimwright.llm import samples, textbytes
from claimwright.llm.common import text_or_empty

WINDOW, STRIDE = 48, 36
HIDDEN, DIM = 8, 6
GRAM_BITS, GRAMS = 15, (3, 4, 5)
BLOCK = 2048
#: Decay of the vectors of words and n-grams, as a share of the mean loss of so many texts.
DECAY = 2.6
INPUTS = 2 * DIM + 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lexicon:
    """The distinct words of some texts, with the hashed n-grams of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = textbytes.Words(data, offsets)
        self.first = words.first
        self.hash, where, self.ids = np.unique(words.hash, return_index=True, return_inverse=True)
        self.ids = self.ids.astype(np.int32)
        size = words.size[where]
        # Every distinct word once, with a border byte on both sides.
        total = size + 2
        starts = np.concatenate([[0], np.cumsum(total)])
        flat = np.full(int(starts[-1]), 1, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[starts[:-1]] = False
        inner[starts[1:] - 1] = False
        place = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
        flat[inner] = words.data[np.repeat(words.start[where], size) + place]
        owner = np.repeat(np.arange(len(size)), total)
        owner = owner.astype(np.int32)
        codes, owners = [], []
        c = flat.astype(np.uint32) + np.uint32(1)
        rolling = c.copy()
        for n in range(2, max(GRAMS) + 1):
            rolling = rolling[:-1] * np.uint32(257) + c[n - 1 :]
            if n in GRAMS:
                whole = owner[: len(rolling)] == owner[n - 1 :]
                codes.append((((rolling[whole] ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32))
                owners.append(owner[: len(rolling)][whole])
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        self.grams = np.concatenate(codes)[order] if codes else np.zeros(0, np.int32)
        self.gram_count = np.bincount(owners, minlength=len(size))
        self.gram_start = np.concatenate([[0], np.cumsum(self.gram_count)[:-1]]).astype(np.int64)

    def blocks(self, words: int = 32_768) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Words by blocks: their slice, their n-grams, and where each word's begin."""
        for low in range(0, len(self.hash), words):
            high = min(low + words, len(self.hash))
            first = int(self.gram_start[low])
            last = int(self.gram_start[high - 1] + self.gram_count[high - 1])
            yield slice(low, high), self.grams[first:last], self.gram_start[low:high] - first


def windows(first: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and words of all overlapping windows; the last ends with its text.

    A text without words has none.
    """
    count = np.diff(first)
    extra = np.where(count > size, -(-(count - size) // stride), 0)
    per = np.where(count > 0, 1 + extra, 0)
    text = np.repeat(np.arange(len(count)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    own = count[text]
    start = np.minimum(k * stride, np.maximum(own - size, 0))
    return text, first[:-1][text] + start, np.minimum(own, size)


@dataclass
class Network:
    """Parameters; ``gates`` hold update, reset and candidate columns side by side."""

    vocabulary: np.ndarray
    word_odds: np.ndarray
    gram_odds: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, vocabulary, word_odds, gram_odds, seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        p = {
            "words": normal(len(vocabulary) + 1, DIM, s=0.1),
            "grams": normal(1 << GRAM_BITS, DIM, s=0.1),
            "attend": normal(2 * HIDDEN, HIDDEN, s=0.3),
            "pick": normal(HIDDEN, s=0.3),
            "out": normal(2 * HIDDEN, s=0.3),
            "bias": np.full(1, -2, np.float32),
            # The largest log odds in a window speaks from the start; the rest is learnt beside it.
            "skip": np.full(1, 1, np.float32),
        }
        for way in "fb":
            p[f"in_{way}"] = normal(INPUTS, 3 * HIDDEN, s=0.3)
            p[f"rec_{way}"] = normal(HIDDEN, 3 * HIDDEN, s=0.3)
            p[f"b_{way}"] = np.zeros(3 * HIDDEN, np.float32)
        p["words"][0] = 0
        return cls(vocabulary, word_odds, gram_odds, p)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Row in the word table, 0 for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Input vector of each distinct word, and its row in the word table."""
        row = self.known(lexicon.hash)
        x = np.empty((len(row), INPUTS), np.float32)
        x[:, :DIM] = self.p["words"][row]
        x[:, 2 * DIM] = self.word_odds[row]
        for own, grams, starts in lexicon.blocks():  # each word has some n-gram
            many = lexicon.gram_count[own].astype(np.float32)
            odds = self.gram_odds[grams]
            x[own, DIM : 2 * DIM] = np.add.reduceat(self.p["grams"][grams], starts, axis=0) / many[:, None]
            x[own, 2 * DIM + 1] = np.maximum.reduceat(odds, starts)
            x[own, 2 * DIM + 2] = np.add.reduceat(odds, starts) / many
        return x, row

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from each distinct word; a last row of zeros pads."""
        p = self.p
        out = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
        out[:-1, : 3 * HIDDEN] = x @ p["in_f"] + p["b_f"]
        out[:-1, 3 * HIDDEN :] = x @ p["in_b"] + p["b_b"]
        return out

    def forward(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows ``ids`` (rows by places); ``mask`` is None where all are full."""
        p, (n, length), h = self.p, ids.shape, HIDDEN
        states = np.empty((length, n, 2 * h), np.float32)
        trace = {"f": [], "b": []}
        for way, low in (("f", 0), ("b", 3 * h)):
            rec, part = p[f"rec_{way}"], table[:, low : low + 3 * h]
            now = np.zeros((n, h), np.float32)
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                x = part[ids[:, t]]
                gates = _sigmoid(x[:, : 2 * h] + now @ rec[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + (r * now) @ rec[:, 2 * h :])
                after = now + z * (c - now)
                if mask is not None:
                    after = np.where(mask[:, t, None], after, now)
                if keep:
                    trace[way].append((t, now, z, r, c))
                now = after
                states[t, :, :h] = now if way == "f" else states[t, :, :h]
                if way == "b":
                    states[t, :, h:] = now
        a = np.tanh(states @ p["attend"])
        e = a @ p["pick"]
        if mask is not None:
            e = np.where(mask.T, e, -30)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, states, a, w, pooled, trace) if keep else logits

    def gradients(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, top: np.ndarray | float = 0.0):
        """Loss and gradients of the shared weights and of the rows of ``table``; ``top`` are the windows' largest log odds."""
        p, h, n = self.p, HIDDEN, len(ids)
        logits, states, a, w, pooled, trace = self.forward(table, ids, mask, keep=True)
        logits = logits + p["skip"][0] * top
        chance = _sigmoid(logits)
        pull = ((chance - label) / n).astype(np.float32)
        g = {"out": pooled.T @ pull, "bias": pull.sum(keepdims=True), "skip": (pull * top).sum(keepdims=True)}
        d_pooled = pull[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["pick"] = (a * d_e[:, :, None]).sum((0, 1))
        d_a = d_e[:, :, None] * p["pick"] * (1 - a * a)
        g["attend"] = np.tensordot(states, d_a, ((0, 1), (0, 1)))
        d_states += d_a @ p["attend"].T
        d_table = np.zeros_like(table)
        for way, low in (("f", 0), ("b", 3 * h)):
            rec = p[f"rec_{way}"]
            d_rec, d_now = np.zeros_like(rec), np.zeros((n, h), np.float32)
            side = slice(0, h) if way == "f" else slice(h, 2 * h)
            for t, now, z, r, c in reversed(trace[way]):
                d_after = d_now + d_states[t, :, side]
                real = mask[:, t, None]
                d_cell = np.where(real, d_after, 0)
                d_c = d_cell * z * (1 - c * c)
                d_z = d_cell * (c - now) * z * (1 - z)
                d_rn = d_c @ rec[:, 2 * h :].T
                d_r = d_rn * now * r * (1 - r)
                d_gates = np.hstack([d_z, d_r])
                d_now = np.where(real, d_cell * (1 - z) + d_rn * r + d_gates @ rec[:, : 2 * h].T, d_after)
                d_rec[:, 2 * h :] += (r * now).T @ d_c
                d_rec[:, : 2 * h] += now.T @ d_gates
                np.add.at(d_table[:, low : low + 3 * h], ids[:, t], np.hstack([d_gates, d_c]))
            g[f"rec_{way}"] = d_rec
        loss = float(np.mean(np.logaddexp(0, logits) - label * logits))
        return loss, g, d_table[:-1]


def _padded(ids: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(WINDOW)
    mask = place < size[:, None]
    return np.where(mask, ids[np.minimum(start[:, None] + place, len(ids) - 1)], pad), mask


def window_logits(net: Network, lexicon: Lexicon, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = net.inputs(lexicon)[0]
    table = net.projected(x)
    out = net.p["skip"][0] * largest_odds(x, lexicon, start, size)
    full = size == WINDOW
    for rows, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full), False)):
        for low in range(0, len(rows), BLOCK):
            own = rows[low : low + BLOCK]
            if whole:
                out[own] += net.forward(table, lexicon.ids[start[own, None] + np.arange(WINDOW)], None)
            else:
                out[own] += net.forward(table, *_padded(lexicon.ids, start[own], size[own], len(lexicon.hash)))
    return out


SMOOTHING = 4.0


def _log_odds(with_0: np.ndarray, with_1: np.ndarray) -> np.ndarray:
    """Log odds of label 1 among the texts that have a feature, against all features.

    Smoothed towards the share of all, so that a rare feature says little.
    """
    share = max(1, with_1.sum()) / max(2, with_1.sum() + with_0.sum())
    odds = np.log((with_1 + SMOOTHING * share) / (with_0 + SMOOTHING * (1 - share))) - np.log(share / (1 - share))
    return np.clip(odds, -4, 4).astype(np.float32)


def _feature_counts(lexicon: Lexicon, labels: np.ndarray, half: np.ndarray, texts: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have each word and each n-gram, by half and label; a block of texts at a time."""
    n_words, n_grams = len(lexicon.hash), 1 << GRAM_BITS
    words, grams = np.zeros((2, 2, n_words), np.int32), np.zeros((2, 2, n_grams), np.int32)
    for low in range(0, len(labels), texts):
        high = min(low + texts, len(labels))
        ids = lexicon.ids[lexicon.first[low] : lexicon.first[high]]
        owner = np.repeat(np.arange(high - low), np.diff(lexicon.first[low : high + 1]))
        pair = np.unique(owner.astype(np.int64) * max(n_words, 1) + ids)
        owner, ids = pair // max(n_words, 1), pair % max(n_words, 1)
        np.add.at(words, (half[low + owner], labels[low + owner], ids), 1)
        count = lexicon.gram_count[ids]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lexicon.gram_start[ids], count)
        pair = np.unique((np.repeat(owner, count) << GRAM_BITS) + lexicon.grams[at])
        owner = pair >> GRAM_BITS
        np.add.at(grams, (half[low + owner], labels[low + owner], pair & (n_grams - 1)), 1)
    return words, grams


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, grad in g.items():
            m, v = self.state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 6, least_steps: int = 150, batch: int = 64, rate: float = 0.01, seed: int = 5, most_words: int = 20_000) -> Network:
    """Train on texts with labels 0 and 1; both must occur.

    Word vectors exist for the ``most_words`` words that occur in most training texts.
    There are ``epochs`` epochs, or as many as make ``least_steps`` steps. Each finds the worst window of every text and learns from it, and for texts
    of label 0 from one more window. The log odds that a text is trained with come from
    the other half of the texts: its own would give its label away.
    """
    data, offsets = textbytes.joined(pa.array(texts, pa.string()))
    lexicon = Lexicon(data, offsets)
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    words, grams = _feature_counts(lexicon, labels, half)
    spread = words.sum((0, 1))
    chosen = np.argsort(-spread, kind="stable")[:most_words]
    chosen = np.sort(chosen[spread[chosen] >= 5])

    def odds(of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        w, g = words[of].sum(0), grams[of].sum(0)
        return np.concatenate([[0], _log_odds(*w)[chosen]]).astype(np.float32), _log_odds(*g)

    crossed = [odds([1 - k]) for k in (0, 1)]
    net = Network.new(lexicon.hash[chosen], *crossed[0], seed)
    who, start, size = windows(lexicon.first)
    rng, adam = np.random.default_rng(seed), _Adam(rate)
    epoch = steps = 0
    while len(who) and (epoch < epochs or steps < least_steps):
        logits = np.empty(len(who), np.float32)
        for k in (0, 1):
            net.word_odds, net.gram_odds = crossed[k]
            own = np.flatnonzero(half[who] == k)
            logits[own] = (window_logits if epoch else window_odds)(net, lexicon, start[own], size[own])
        order = np.lexsort((-logits, who))
        worst = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])] if len(order) else order
        more = rng.permutation(np.flatnonzero(labels[who] == 0))[: int((labels == 0).sum())]
        picked = rng.permutation(np.concatenate([worst, more]))
        parts = []
        for k in (0, 1):
            own = picked[half[who[picked]] == k]
            parts += [(k, part) for part in np.array_split(own, max(1, len(own) // batch)) if len(part)]
        for turn in rng.permutation(len(parts)):
            k, own = parts[turn]
            net.word_odds, net.gram_odds = crossed[k]
            adam.step(net.p, _batch_gradients(net, lexicon, start[own], size[own], labels[who[own]], DECAY / len(texts)))
        epoch, steps = epoch + 1, steps + len(parts)
    net.word_odds, net.gram_odds = odds([0, 1])
    return net


def _batch_gradients(net: Network, lexicon: Lexicon, start: np.ndarray, size: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    ids, mask = _padded(lexicon.ids, start, size, -1)
    used, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    if used[0] == -1:
        used, local = used[1:], np.where(ids == -1, len(used) - 1, local - 1)
    part = _part(lexicon, used)
    x, row = net.inputs(part)
    top = np.append(x[:, 2 * DIM : 2 * DIM + 2].max(1), -9).astype(np.float32)[np.where(mask, local, -1)].max(1)
    _, g, d_table = net.gradients(net.projected(x), local, mask, label.astype(np.float32), top)
    h = 3 * HIDDEN
    d_x = d_table[:, :h] @ net.p["in_f"].T + d_table[:, h:] @ net.p["in_b"].T
    for way, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        g[f"in_{way}"], g[f"b_{way}"] = x.T @ d_table[:, cols], d_table[:, cols].sum(0)
    # A little decay keeps the vectors of rare words and n-grams small.
    g["words"], g["grams"] = decay * net.p["words"], decay * net.p["grams"]
    np.add.at(g["words"], row[row > 0], d_x[row > 0, :DIM])
    share = d_x[:, DIM : 2 * DIM] / np.maximum(part.gram_count, 1)[:, None]
    np.add.at(g["grams"], part.grams, np.repeat(share, part.gram_count, axis=0))
    return g


def _part(lexicon: Lexicon, used: np.ndarray) -> Lexicon:
    """The same words, of some rows only."""
    part = object.__new__(Lexicon)
    part.hash, part.gram_count = lexicon.hash[used], lexicon.gram_count[used]
    part.gram_start = np.concatenate([[0], np.cumsum(part.gram_count)[:-1]]).astype(np.int64)
    at = np.arange(int(part.gram_count.sum())) - np.repeat(part.gram_start, part.gram_count)
    part.grams = lexicon.grams[at + np.repeat(lexicon.gram_start[used], part.gram_count)]
    return part


def largest_odds(x: np.ndarray, lexicon: Lexicon, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The largest log odds of a word or n-gram in each window, from the inputs of its words."""
    worst = np.append(x[:, 2 * DIM : 2 * DIM + 2].max(1), -9).astype(np.float32)
    out = np.empty(len(start), np.float32)
    for low in range(0, len(start), BLOCK):
        ids, _ = _padded(lexicon.ids, start[low : low + BLOCK], size[low : low + BLOCK], len(lexicon.hash))
        out[low : low + BLOCK] = worst[ids].max(1)
    return out


def window_odds(net: Network, lexicon: Lexicon, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For the first epoch: the largest log odds of a word in each window."""
    return largest_odds(net.inputs(lexicon)[0], lexicon, start, size)


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Probability for each text; 0 for a text without words."""
    out = np.zeros(len(texts))
    for low, high in textbytes.chunks(texts):
        lexicon = Lexicon(*textbytes.joined(texts.slice(low, high - low)))
        who, start, size = windows(lexicon.first)
        if len(who):
            logits = window_logits(net, lexicon, start, size)
            heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out[low + who[heads]] = _sigmoid(np.maximum.reduceat(logits, heads).astype(np.float64))
    return out


def excerpt(text: Column, most_chars: int, parts: int = 8) -> Column:
    """The text, or of a longer one ``parts`` pieces evenly spread from its start to its end."""
    size = most_chars // parts - 1
    step = (F.length(text) - size) / (parts - 1)
    pieces = [F.substring(text, (step * k).cast("int") + 1, F.lit(size)) for k in range(parts)]
    return F.when(F.length(text) <= most_chars, text).otherwise(F.concat_ws(" ", *pieces))


def score_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_label: tuple[int, int] = (2_400, 1_200),
    most_chars: int = 6_000,
) -> DataFrame:
    """One row per document: ``id_col, score``, the probability that it is toxic.

    ``labelled`` has ids of ``docs`` with labels 0 and 1 (null labels are left out, of
    repeated ids the larger counts). The network is fitted on at most ``rows_per_label``
    texts of label 0 and of label 1, chosen by hash of the id; of a text longer than
    ``most_chars`` it learns from pieces spread over all of it, and of a repeated id from one text;
    scoring covers every window of every text. Without rows of both labels every score
    is 0. A null text, or one without words, scores 0. Null ids and repeated rows pass
    through; extra columns are not read; an empty table gives no rows.
    """
    known = (
        labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    )
    fit_for = known.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    picked = samples.bounded(fit_for.where("__label = 1"), rows_per_label[1]).unionAll(
        samples.bounded(fit_for.where("__label = 0"), rows_per_label[0])
    )
    read = docs.select(id_col, excerpt(text_or_empty(F.col(text_col)), most_chars).alias("__excerpt"))
    rows = samples.with_texts(read, picked, id_col, "__excerpt").collect()
    rows.sort(key=lambda r: (r["__id"], r["__text"]))
    labels = np.array([r["__label"] for r in rows], np.int64)
    both = len(set(labels.tolist())) == 2
    net = fit([r["__text"] for r in rows], labels) if both else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = score_texts(sent.value, batch.column(1)) if sent.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return read.mapInArrow(score, f"id {id_type}, score double").withColumnRenamed("id", id_col)
