"""Many class-weighted logistic regressions over word counts, fitted in the same passes.

Models that differ in regularisation, row weights (balancing seeds) or use of metadata
share one stored feature table. A pass over it evaluates every model at the point it wants
to try next: tasks add up losses and gradients of all of them, and a tree of sums brings
these to the driver, whose share depends on words and models only. Each model's L-BFGS search goes on
by itself, so a model comes out as if it were fitted alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimwright.functions import arrays as A, maths as M
from claimwright.session import settle

MOST_WORDS = 1 << 18
#: Features that are summed as one row, and rows that one task of the tree adds up.
SLICE, FAN = 1024, 64
#: Rows of a batch that are encoded at once, which bounds a worker's memory.
_ROWS = 4096
_SUMS = "slice int, part int, sums binary"


@dataclass(frozen=True)
class Setting:
    """One model: its L2 strength, the column of its row weights, and whether it sees metadata."""

    name: str
    reg: float
    weight: str
    use_meta: bool = True


@dataclass(frozen=True)
class Models:
    """Coefficients ``(words + metadata slots, models)`` and intercepts."""

    words: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    settings: tuple[Setting, ...]

    def pick(self, k: int) -> Models:
        return Models(self.words, self.coefficients[:, [k]], self.intercepts[[k]], (self.settings[k],))


def frequent_words(train: DataFrame, tokens: str, most_words: int = MOST_WORDS) -> list[str]:
    """The words in most rows; equally frequent ones by spelling."""
    words = train.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in words.where("word is not null").orderBy(F.desc("n"), "word").limit(most_words).collect()]


def _dense(meta: str | None) -> Column:
    return F.array().cast("array<double>") if meta is None else A.gate(F.col(meta), F.col("has_meta")).cast("array<double>")


def _encoded(tokens: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and count of the known words of each row."""
    sizes = pc.fill_null(tokens.value_lengths(), 0).to_numpy()
    ids = pc.index_in(tokens.flatten(), value_set=words)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), sizes)[known]
    keys, counts = np.unique(row * np.int64(max(len(words), 1)) + ids.drop_null().to_numpy().astype(np.int64), return_counts=True)
    return keys // max(len(words), 1), keys % max(len(words), 1), counts.astype(np.float64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _margins(row: np.ndarray, word: np.ndarray, count: np.ndarray, dense: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    n_words = len(coefficients) - dense.shape[1]
    z = dense @ coefficients[n_words:] + intercepts
    if len(row):
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        z[row[heads]] += np.add.reduceat(count[:, None] * coefficients[word], heads, axis=0)
    return z


def feature_table(train: DataFrame, words: list[str], tokens: str, meta: str | None, settings: tuple[Setting, ...]) -> DataFrame:
    """Stored rows ``(words, counts, dense, label, weights)``; rows that weigh nothing in all models are left out."""
    vocabulary = train.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            row, word, count = _encoded(batch.column(0), known)
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (word.astype(np.int32), count)]
            yield pa.RecordBatch.from_arrays([*lists, *batch.columns[1:]], ["words", "counts", "dense", "label", "weights"])

    weights = F.array(*[F.coalesce(F.col(s.weight).cast("double"), F.lit(0.0)) for s in settings])
    rows = train.select(F.col(tokens).alias("_t"), _dense(meta).alias("_d"), F.col("label").cast("double").alias("_y"), weights.alias("_w"))
    schema = "words array<int>, counts array<double>, dense array<double>, label double, weights array<double>"
    return settle(rows.where(F.exists("_w", lambda w: w > 0)).mapInArrow(encode, schema))


def _tree_sum(frame: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of equally long vectors by slice; no task adds more than ``FAN`` rows, or one row a task above that."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([0], pa.int32()), "sums": [total.tobytes()]})

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        level = frame.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        frame = level.groupBy("slice", "part").applyInArrow(lambda key, t: add(t).set_column(1, "part", pa.array([key[1].as_py()], pa.int32())), _SUMS)
    return {r["slice"]: np.frombuffer(bytes(r["sums"]), np.float64) for r in frame.groupBy("slice").applyInArrow(add, _SUMS).collect()}


def _sums(table: DataFrame, shape: tuple[int, int], rows_of) -> np.ndarray:
    """Sum over all tasks of the matrices that ``rows_of`` makes of their batches."""
    features, models = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            rows_of(batch, total)
        slices = [k for k in range(0, features, SLICE) if total[k : k + SLICE].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k // SLICE for k in slices], pa.int32()),
                pa.array([part] * len(slices), pa.int32()),
                pa.array([total[k : k + SLICE].tobytes() for k in slices], pa.binary()),
            ],
            ["slice", "part", "sums"],
        )

    out = np.zeros(shape)
    for k, values in _tree_sum(table.mapInArrow(add, _SUMS), table.rdd.getNumPartitions()).items():
        out[k * SLICE : (k + 1) * SLICE] = values.reshape(-1, models)
    return out


def _batch(batch: pa.RecordBatch, dims: int, models: int):
    words, counts = batch.column(0), batch.column(1)
    row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy())
    dense, weights = _matrix(batch.column(2), dims), _matrix(batch.column(4), models)
    return row, words.flatten().to_numpy(), counts.flatten().to_numpy(), dense, batch.column(3).to_numpy(), weights


def _add_products(total: np.ndarray, row, word, count, dense, per_row: np.ndarray, power: int = 1) -> None:
    """Adds ``X^T per_row`` for word counts and dense columns, each raised to ``power``."""
    n_words = len(total) - dense.shape[1] - 2
    for m in range(per_row.shape[1]):
        total[:n_words, m] += np.bincount(word, weights=count**power * per_row[row, m], minlength=n_words)
    total[n_words:-2] += (dense**power).T @ per_row


def spreads(table: DataFrame, features: int, dims: int, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted standard deviation of each feature under each model, and the sum of weights."""

    def moments(power: int):
        def rows_of(batch, total):
            row, word, count, dense, _, weights = _batch(batch, dims, models)
            _add_products(total, row, word, count, dense, weights, power)
            total[-1] += weights.sum(axis=0)

        return _sums(table, (features + 2, models), rows_of)

    first, second = moments(1), moments(2)
    n = np.maximum(first[-1], 1e-300)
    return np.sqrt(np.maximum(second[:-2] / n - (first[:-2] / n) ** 2, 0)), first[-1]


def losses(table: DataFrame, coefficients: np.ndarray, intercepts: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sums of log losses and their gradients by coefficient and intercept, for all models in one pass."""
    models = len(intercepts)
    shared = table.sparkSession.sparkContext.broadcast((coefficients, intercepts))

    def rows_of(batch, total):
        b, b0 = shared.value
        row, word, count, dense, label, weights = _batch(batch, dims, models)
        z = _margins(row, word, count, dense, b, b0)
        y = label[:, None]
        pull = weights * (0.5 * (1 + np.tanh(z / 2)) - y)
        _add_products(total, row, word, count, dense, pull)
        total[-2] += pull.sum(axis=0)
        total[-1] += (weights * (np.logaddexp(0, z) - y * z)).sum(axis=0)

    sums = _sums(table, (len(coefficients) + 2, models), rows_of)
    shared.unpersist()
    return sums[-1], sums[:-2], sums[-2]


class Search:
    """L-BFGS for one model: ``trial`` is the next point to evaluate, ``tell`` takes its value and gradient."""

    def __init__(self, size: int, iterations: int, memory: int = 10, tolerance: float = 1e-6):
        self.point = self.trial = np.zeros(size)
        self.value = self.gradient = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.left, self.memory, self.tolerance, self.done = iterations, memory, tolerance, False

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            if not value <= self.value + 1e-4 * self.step * self.slope:
                self.step /= 2
                self.done = self.step < 1e-10
                self.trial = self.point + self.step * self.direction
                return
            s, y = self.trial - self.point, gradient - self.gradient
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
            self.left -= 1
            if abs(self.value - value) <= self.tolerance * max(abs(value), abs(self.value), 1e-12):
                self.left = 0
        self.point, self.value, self.gradient = self.trial, value, gradient
        if self.left <= 0 or not gradient.any():
            self.done = True
            return
        self.direction = -self._scaled(gradient)
        self.slope = float(gradient @ self.direction)
        if self.slope >= 0:
            self.pairs, self.direction = [], -gradient
            self.slope = -float(gradient @ gradient)
        self.step = 1.0 if self.pairs else min(1.0, 1 / np.linalg.norm(gradient))
        self.trial = self.point + self.step * self.direction

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, back = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        return q


def fit_models(
    train: DataFrame,
    settings: list[Setting] | tuple[Setting, ...],
    tokens: str = "truncated_tokens",
    meta: str | None = "meta",
    most_words: int = MOST_WORDS,
    iterations: int = 25,
) -> Models:
    """Fits all ``settings`` together; one pass over the stored features for each step of all.

    ``train`` has ``label`` 0 or 1 and the weight columns; a weight of 0 or null leaves a
    row out of a model. The penalty is on coefficients of features scaled to unit spread,
    none on the intercept. A feature without spread gets no coefficient. Words are the
    ``most_words`` most frequent ones of the rows given.
    """
    settings = tuple(settings)
    words = frequent_words(train, tokens, most_words)
    table = feature_table(train, words, tokens, meta, settings)
    models = len(settings)
    first = table.select(F.max(F.size("dense"))).first()[0]
    dims = first or 0
    features = len(words) + dims
    # A task sends one matrix of sums however many rows it read, so tasks follow the cores and not the rows.
    table = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)
    spread, mass = spreads(table, features, dims, models)
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0)
    for k, s in enumerate(settings):
        if not s.use_meta:
            scale[len(words) :, k] = 0.0
    mass = np.maximum(mass, 1e-300)
    searches = [Search(features + 1, iterations) for _ in settings]
    while not all(s.done for s in searches):
        points = np.stack([s.trial for s in searches], axis=1)
        loss, by_feature, by_intercept = losses(table, points[:-1] * scale, points[-1], dims)
        for k, (search, setting) in enumerate(zip(searches, settings)):
            if not search.done:
                at = points[:-1, k]
                gradient = by_feature[:, k] * scale[:, k] / mass[k] + setting.reg * at
                search.tell(loss[k] / mass[k] + setting.reg / 2 * float(at @ at), np.append(gradient, by_intercept[k] / mass[k]))
    points = np.stack([s.point for s in searches], axis=1)
    return Models(words, points[:-1] * scale, points[-1], settings)


def margins(models: Models, df: DataFrame, tokens: str = "truncated_tokens", meta: str | None = "meta", out: str = "margins") -> DataFrame:
    """Adds the log odds of class 1 under each model; rows stay in their partitions.

    Only tokens and metadata reach Python, some rows of a batch at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)
    dims = len(models.coefficients) - len(models.words)

    @F.arrow_udf("array<double>")
    def score(words: pa.Array, given: pa.Array) -> pa.Array:
        own = shared.value
        known = pa.array(own.words, pa.string())
        parts = []
        for k in range(0, len(words), _ROWS):
            some, values = words.slice(k, _ROWS), given.slice(k, _ROWS)
            dense = _matrix(values, dims) if dims else np.zeros((len(some), 0))
            z = _margins(*_encoded(some, known), dense, own.coefficients, own.intercepts)
            cuts = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            parts.append(pa.ListArray.from_arrays(cuts, pa.array(z.ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, score(F.col(tokens), _dense(meta if dims else None)))


def with_verdict(df: DataFrame, margin: Column) -> DataFrame:
    """Logits, prediction and confidence of a log odds; the two logits differ by it."""
    out = df.withColumns({"logit0": -margin / 2, "logit1": margin / 2})
    return out.withColumns(
        {
            "pred": M.predicted_class(F.col("logit0"), F.col("logit1")),
            "conf": M.confidence(F.col("logit0"), F.col("logit1")),
        }
    )


def coefficient_table(spark: SparkSession, models: Models, k: int = 0) -> DataFrame:
    """``(word, coefficient)`` of one model, without words that have none."""
    values = models.coefficients[: len(models.words), k]
    table = pa.table({"word": pa.array(models.words, pa.string()), "coefficient": pa.array(values)})
    return spark.createDataFrame(table.filter(pa.array(values != 0)))
