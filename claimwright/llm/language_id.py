"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier over hashed
character trigrams says how likely the bit is set. A text's language is the one whose
codeword has the least loss, summed over the bits and weighted by how reliable each
bit was in training. A narrow lead over the second language flags the text as
ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from claimwright.llm import samples, textbytes
from claimwright.llm.common import text_or_empty

FEATURES = 4096
#: Parts that the sampling of one language is spread over.
SALTS = 64
UNDETERMINED = "und"

_classes = np.zeros(256, np.uint32)
_classes[97:123] = np.arange(1, 27)
_classes[128:] = 27 + (np.arange(128, 256) & 31)


def trigram_codes(data: np.ndarray) -> np.ndarray:
    """A feature number for the three bytes from each place on; one less than two places."""
    c = _classes[textbytes.folded(data)]
    code = (c[:-2] << np.uint32(12)) | (c[1:-1] << np.uint32(6)) | c[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int32)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges and their feature rows. Texts must have a space at each end."""
    for low, high in textbytes.chunks(texts):
        data, offsets = textbytes.joined(texts.slice(low, high - low))
        codes = trigram_codes(data) if len(data) > 2 else np.zeros(0, np.int32)
        ends = np.maximum(offsets[1:] - 2, offsets[:-1])
        for at in range(0, high - low, 256):
            end = min(at + 256, high - low)
            counts = np.empty((end - at, FEATURES), np.float32)
            for k in range(at, end):
                counts[k - at] = np.bincount(codes[offsets[k] : ends[k]], minlength=FEATURES)
            yield low + at, low + end, textbytes.root_scaled(counts)


def codewords(n: int, seed: int = 11, tries: int = 200) -> np.ndarray:
    """``n`` codewords of -1/1: all splits in two for up to 6 languages, else random ones far apart."""
    if n <= 6:
        splits = np.arange(1, max(2, 1 << (n - 1)))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1)
    rng = np.random.default_rng(seed)
    bits, best, gap = max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(tries):
        words = rng.choice([-1, 1], (n, bits))
        apart = (bits - words @ words.T) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > gap and (np.abs(words.sum(0)) < n).all():
            best, gap = words, least
    return best


@dataclass
class Codes:
    """Languages, their codewords, the bit classifiers and how much each bit counts."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        each = np.logaddexp(0, -margins[:, None, :] * self.words[None])
        return (each * self.trust).sum(2) / self.trust.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and lead over the second (1 where there is no second)."""
        loss = self.losses(x)
        best = loss.argmin(1)
        odds = np.exp((loss.min(1, keepdims=True) - loss) * self.words.shape[1])
        share = odds / odds.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else np.ones(len(x))
        return best, ranked[:, -1], lead


def fit_bits(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Logistic bit classifiers by Adam over all rows."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        pull = -target * weight / (1 + np.exp(target * (x @ w + b)))
        grad = x.T @ pull + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * pull.sum(0)
    return w, b


def fit_codes(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 0.15, decay: float = 1e-5) -> Codes:
    """Bit classifiers fitted on all rows, rows of rare languages weighing more.

    A bit weighs by how often it is right on rows that it was not fitted on: every fifth
    row is held out from a first, shorter fit.
    """
    languages = sorted(set(labels))
    words = codewords(len(languages))
    number = {name: k for k, name in enumerate(languages)}
    y = np.array([number[name] for name in labels])
    target = words[y].astype(np.float32)
    weight = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]
    held = np.random.default_rng(3).permutation(len(x)) % 5 == 0
    if held.all() or not held.any():
        held[:] = False
    trial_w, trial_b = fit_bits(x[~held], target[~held], weight[~held], max(steps // 3, 1), rate, decay)
    # Add-one: a bit that a few held-out rows all agree on is not taken for certain.
    right = (np.sign(x[held] @ trial_w + trial_b) == target[held]).sum(0)
    accuracy = np.clip((right + 1) / (held.sum() + 2), 0.5, None)
    w, b = fit_bits(x, target, weight, steps, rate, decay)
    return Codes(languages, words, w, b, np.log(accuracy / (1 - accuracy)) + 1e-3)


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int, max_rows: int
) -> tuple[np.ndarray, list[str]]:
    """Features and languages of the sample; each row is of fixed size whatever its text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    by_hash = lambda *keys: Window.partitionBy(*keys).orderBy(F.xxhash64("__id"), "__id")
    # First the smallest hashes of each language within its salts, which becomes a limit
    # before the shuffle; then those of the language, from so many rows at most.
    salted = known.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    few = salted.withColumn("__n", F.dense_rank().over(by_hash("__lang", "__salt"))).where(F.col("__n") <= rows_per_language)
    few = few.groupBy("__lang", "__id").agg(F.first("__n").alias("__m"))
    picked = few.withColumn("__n", F.row_number().over(by_hash("__lang"))).where(F.col("__n") <= rows_per_language)
    texts = samples.with_texts(docs, samples.bounded(picked.select("__id", "__lang"), max_rows), id_col, text_col, {"__lang": lang_col})

    def featurise(batches):
        for batch in batches:
            for low, high, x in features(batch.column(1)):
                rows = [row.tobytes() for row in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(rows, pa.binary())], ["lang", "x"])

    padded = F.concat(F.lit(" "), text_or_empty(F.col("__text")), F.lit(" "))
    got = texts.select(F.col("__lang").cast("string").alias("lang"), padded).mapInArrow(featurise, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), FEATURES)
    return x, [r["lang"] for r in got]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = textbytes.joined(texts)
    before = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    found = before[offsets[1:]] > before[offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(map(str.isalpha, texts[k].as_py() or ""))
    return found


def identify(
    docs: DataFrame,
    training: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 500,
    max_rows: int = 5_000,
    min_lead: float = 0.2,
) -> DataFrame:
    """One row per document: ``id_col, lang_pred, score, ambiguous``.

    Learns from ``training``: at most ``rows_per_language`` ids of each language, chosen
    by hash of the id, and ``max_rows`` in all; a repeated id counts once for each of its
    languages, with its smallest text of that language. ``score`` is the share of the winner
    among all languages by loss; ``ambiguous`` says that it leads the second by less than
    ``min_lead``. A text that is null or has no letter gets ``und`` with score 0 and is
    ambiguous; so does every text when nothing could be learnt. Repeated rows and null
    ids pass through; extra columns are not read; an empty table gives no rows.
    """
    x, labels = training_rows(training, id_col, text_col, lang_col, rows_per_language, max_rows)
    codes = fit_codes(x, labels) if labels else None
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n, texts = batch.num_rows, batch.column(1)
            names = np.full(n, UNDETERMINED, object)
            score, ambiguous = np.zeros(n), np.ones(n, bool)
            if model is not None and n:
                known = has_letter(texts)
                spoken = np.array(model.languages, object)
                for low, high, x in features(texts):
                    best, share, lead = model.decode(x)
                    sure = known[low:high]
                    names[low:high][sure] = spoken[best][sure]
                    score[low:high][sure] = share[sure]
                    ambiguous[low:high][sure] = lead[sure] < min_lead
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)],
                ["id", "lang_pred", "score", "ambiguous"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    padded = F.concat(F.lit(" "), text_or_empty(F.col(text_col)), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("id"), padded.alias("text"))
    out = rows.mapInArrow(predict, f"id {id_type}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
