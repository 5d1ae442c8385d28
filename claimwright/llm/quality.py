"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network that minimises the
non-negative unbiased risk: ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. The
class prior is estimated from the two samples themselves by the best-bin rule: where a
positive-against-unlabelled classifier is surest, nearly all unlabelled texts are
positive, so the ratio of the two shares there bounds the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm import samples, textbytes
from claimwright.llm.common import text_or_empty

SHAPES = 512
STATS = 20

#: Shape of a byte: letters, capitals, digits and other bytes by kind, punctuation each.
_shape = np.arange(256, dtype=np.uint32)
_shape[97:123], _shape[65:91], _shape[48:58], _shape[128:] = ord("a"), ord("A"), ord("0"), ord("z")


def _indicator(chars) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


#: Kinds of bytes whose share is a feature.
_KINDS = [
    _indicator(range(97, 123)), _indicator(range(65, 91)), _indicator(range(48, 58)), _indicator(range(128, 256)),
    _indicator(b" "), _indicator(b"\n"), _indicator(b".,;:?'\"-()"), _indicator(b"!"), _indicator(b"#$%&*@^~+=<>{}[]\\/_`"), _indicator(b"|"),
]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each owner."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    return np.bincount(o[new], minlength=n).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares and means of each text that do not depend on its words' meaning."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    columns = [_sums(kind[data], offsets) / size for kind in _KINDS]
    words = textbytes.Words(data, offsets)
    per = np.diff(words.first)
    many = np.maximum(per, 1).astype(np.float64)
    owner = np.repeat(np.arange(n), per)
    columns.append(_sums(words.size, words.first) / many / 10)
    columns.append(_sums(words.size > 12, words.first) / many)
    h = words.hash
    for back in (1, 2):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (owner[back:] == owner[:-back])
        columns.append(_sums(same, words.first) / many)
    columns.append(_distinct(h, owner, n) / many)
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = h[1:] * np.uint64(3) + h[:-1]
    columns.append(_distinct(pair, owner, n) / many)
    capital = np.zeros(len(h), bool)
    if len(h):
        capital = (data[words.start] >= 65) & (data[words.start] <= 90)
    columns.append(_sums(capital, words.first) / many)
    columns.append(np.log1p(np.diff(offsets)) / 10)
    columns.append(np.log1p(per) / 10)
    columns.append((per == 0).astype(np.float64))
    return np.stack(columns, 1).astype(np.float32)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges and their features: statistics and shares of hashed shape trigrams."""
    for low, high in textbytes.chunks(texts):
        data, offsets = textbytes.joined(texts.slice(low, high - low))
        stats = statistics(data, offsets)
        c = _shape[data]
        codes = np.zeros(0, np.int32)
        if len(c) > 2:
            code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
            codes = ((code * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.int32)
        ends = np.maximum(offsets[1:] - 2, offsets[:-1])
        counts = np.empty((high - low, SHAPES), np.float32)
        for k in range(high - low):
            counts[k] = np.bincount(codes[offsets[k] : ends[k]], minlength=SHAPES)
        yield low, high, np.hstack([stats, textbytes.root_scaled(counts)])


@dataclass
class Network:
    """One hidden layer over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, x: np.ndarray, hidden: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        scale = np.maximum(x.std(0), 1e-3)
        scale[STATS:] = max(1e-3, float(x[:, STATS:].std()))
        return cls(x.mean(0), scale, rng.normal(0, 1 / np.sqrt(d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
                   rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def step(self, z: np.ndarray, pull: np.ndarray, adam: "Adam") -> None:
        """One Adam step for the loss gradient ``pull`` of the logits of scaled rows ``z``."""
        h = np.tanh(z @ self.w1 + self.b1)
        back = pull[:, None] * self.w2 * (1 - h * h)
        adam.step([self.w1, self.b1, self.w2, self.b2], [z.T @ back, back.sum(0), h.T @ pull, pull.sum(keepdims=True)])


class Adam:
    def __init__(self, rate: float, decay: float):
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, None, None

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if self.m is None:
            self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v):
            g = g + self.decay * x
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _batches(n_p: int, n_u: int, epochs: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        p, u = rng.permutation(n_p), rng.permutation(n_u)
        parts = max(1, n_u // size)
        for own_p, own_u in zip(np.array_split(np.resize(p, max(n_p, parts)), parts), np.array_split(np.resize(u, max(n_u, parts)), parts)):
            yield own_p, own_u


def _best_bin(train_p: np.ndarray, train_u: np.ndarray, held_p: np.ndarray, held_u: np.ndarray, hidden: int, epochs: int, seed: int) -> float:
    net = Network.new(np.vstack([train_p, train_u]), hidden, seed)
    adam = Adam(3e-3, 1e-3)
    zp, zu = net.scaled(train_p), net.scaled(train_u)
    for own_p, own_u in _batches(len(zp), len(zu), epochs, 256, seed):
        z = np.vstack([zp[own_p], zu[own_u]])
        y = np.r_[np.ones(len(own_p)), np.zeros(len(own_u))]
        weight = np.r_[np.full(len(own_p), 0.5 / len(own_p)), np.full(len(own_u), 0.5 / len(own_u))]
        logit = np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2[0]
        net.step(z, ((_sigmoid(logit) - y) * weight).astype(np.float32), adam)
    cuts, su = np.sort(net.logits(held_p)), np.sort(net.logits(held_u))
    q_p = 1 - np.arange(len(cuts)) / len(cuts)
    q_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(40) / 2 / len(cuts)) + np.sqrt(np.log(40) / 2 / len(su))
    best = np.argmin((q_u + 1.01 * slack) / q_p)
    return float(q_u[best] / q_p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, epochs: int = 20, seed: int = 1) -> float:
    """Share of positives among the unlabelled, by the best bin of held-out scores.

    Each half is held out once. Returned is the estimate less two standard errors: too
    high a prior lets whole kinds of bad text pass as good, too low a one costs little.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    if half_p < 10 or half_u < 10:
        return 0.5
    (p1, p2), (u1, u2) = (positive[:half_p], positive[half_p:]), (unlabelled[:half_u], unlabelled[half_u:])
    share = (_best_bin(p1, u1, p2, u2, hidden, epochs, seed) + _best_bin(p2, u2, p1, u1, hidden, epochs, seed)) / 2
    share = min(max(share, 0.01), 0.99)
    return float(np.clip(share - 2 * np.sqrt(share * (1 - share) / len(unlabelled)), 0.01, 0.99))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, epochs: int = 30, seed: int = 2) -> Network:
    """Minimise the non-negative risk; where its negative part falls below zero, step back."""
    net = Network.new(np.vstack([positive, unlabelled]), hidden, seed)
    adam = Adam(2e-3, 1e-3)
    zp, zu = net.scaled(positive), net.scaled(unlabelled)
    for own_p, own_u in _batches(len(zp), len(zu), epochs, 256, seed):
        z = np.vstack([zp[own_p], zu[own_u]])
        n = len(own_p)
        logit = np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2[0]
        like = _sigmoid(logit)
        negative = np.logaddexp(0, logit[n:]).mean() - prior * np.logaddexp(0, logit[:n]).mean()
        pull = np.empty(len(z), np.float32)
        if negative >= 0:
            pull[:n] = prior * ((like[:n] - 1) - like[:n]) / n
            pull[n:] = like[n:] / len(own_u)
        else:
            pull[:n] = prior * like[:n] / n
            pull[n:] = -like[n:] / len(own_u)
        net.step(z, pull, adam)
    return net


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, x in features(batch.column(1)):
            rows = [row.tobytes() for row in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(rows, pa.binary())], ["trusted", "x"])


def sample_features(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows of ``(trusted, __text)``: positives, unlabelled."""
    rows = texts.select("trusted", text_or_empty(F.col("__text"))).mapInArrow(_featurise, "trusted boolean, x binary").collect()
    rows.sort(key=lambda r: r["x"])
    of = lambda kind: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["trusted"] == kind]).reshape(-1, STATS + SHAPES)
    rng = np.random.default_rng(0)
    return rng.permutation(of(True)), rng.permutation(of(False))


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    unlabelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    positives: int = 4_000,
    unlabelled_rows: int = 10_000,
) -> DataFrame:
    """One row per document: ``id_col, score``, the probability of good quality.

    ``trusted`` and ``unlabelled`` have ids of ``docs`` in column ``id_col``. The network
    is fitted on at most ``positives`` and ``unlabelled_rows`` of them, chosen by hash of
    the id. With no trusted or no unlabelled text every score is 0.5. Null and empty texts
    are scored like any other, long ones whole. Null ids and repeated rows pass through;
    extra columns are not read; an empty table gives no rows.
    """
    ids = lambda frame: frame.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    picked = samples.bounded(ids(trusted), positives, 1).withColumn("trusted", F.lit(True)).unionAll(
        samples.bounded(ids(unlabelled), unlabelled_rows, 2).withColumn("trusted", F.lit(False))
    )
    good, mixed = sample_features(samples.with_texts(docs, picked, id_col, text_col))
    net = fit_quality(good, mixed, estimate_prior(good, mixed)) if len(good) and len(mixed) else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for low, high, x in features(batch.column(1)):
                    out[low:high] = _sigmoid(model.logits(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(score, f"id {id_type}, score double").withColumnRenamed("id", id_col)
