"""Whitening of embeddings by a bit-sliced scatter matrix.

Each entry becomes an integer. In blocks of rows every dimension is shifted to start at
zero and cut into bit planes, which are packed across the rows into 64-bit words; the
cross-products of two dimensions are then population counts of ANDed planes, weighted by
powers of two. Tasks send one exact sum for each pair of dimensions, so what is gathered
depends on the dimension alone. The sums are centred as integers before ``eigh``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm.vectors import chunks_of, usable

#: Rows packed together; bounds a task's memory and keeps a block's sums within 64 bits.
BLOCK_ROWS = 8192
#: Planes ANDed at once.
PLANE_STEP = 64
SCALE, OFFSET = 64, 1_000_000
_PAIR_SCHEMA = "i int, j int, v decimal(38,0)"
_LONG = 2**63


def quantized(vectors: np.ndarray) -> np.ndarray:
    """``floor(64 * c) + 1000000`` as 64-bit integers; an error where that is no long."""
    scaled = np.floor(vectors * SCALE)
    if len(scaled) and not (np.abs(scaled).max() < 2.0**62):
        raise ValueError("an entry is too large for a 64-bit integer")
    return scaled.astype(np.int64) + OFFSET


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative integers ``(rows, dims)``: packed words, and each plane's dimension and bit."""
    bits = [int(top).bit_length() for top in shifted.max(axis=0)]
    dims = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(dims) else dims
    words = -(-len(shifted) // 64)
    packed = np.zeros((len(dims), words * 8), np.uint8)
    for d in np.flatnonzero(bits):
        own = np.flatnonzero(dims == d)
        flags = (shifted[:, d][None, :] >> bit[own][:, None]) & 1
        cut = np.packbits(flags.astype(np.uint8), axis=1)
        packed[own, : cut.shape[1]] = cut
    return packed.view(np.uint64), dims, bit


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """Population counts of the AND of each two planes; the upper triangle is filled."""
    n = len(planes)
    counts = np.zeros((n, n), np.int64)
    for at in range(0, n, PLANE_STEP):
        own = planes[at : at + PLANE_STEP]
        for other in range(at, n, PLANE_STEP):
            both = own[:, None, :] & planes[None, other : other + PLANE_STEP, :]
            counts[at : at + PLANE_STEP, other : other + PLANE_STEP] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
    lower = np.tril_indices(n, -1)
    counts[lower] = counts.T[lower]
    return counts


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and cross-products of one block of integers, as Python integers."""
    low = x.min(axis=0)
    shifted = x - low
    planes, dims, bit = bit_planes(shifted)
    wide = int(bit.max(initial=0)) > 23
    weights = np.zeros((x.shape[1], len(dims)), object if wide else np.int64)
    for at, (d, b) in enumerate(zip(dims.tolist(), bit.tolist())):
        weights[d, at] = 1 << b
    counts = plane_counts(planes)
    cross = weights.dot(counts.astype(object) if wide else counts).dot(weights.T).astype(object)
    own = weights.dot(np.diag(counts).astype(weights.dtype)).astype(object)
    low, m = low.astype(object), len(x)
    sums = own + m * low
    return sums, cross + np.outer(low, own) + np.outer(own, low) + m * np.outer(low, low)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a whole task: its row count at (-2, dimensions), sums at (-1, d), cross-products at (i, j), i <= j."""
    n, sums, cross = 0, None, None
    for piece in chunks_of(batches, BLOCK_ROWS):
        _, vectors = usable(piece.column(0))
        if not len(vectors):
            continue
        s, c = block_sums(quantized(vectors))
        if sums is None:
            sums, cross = s, c
        elif len(s) != len(sums):
            raise ValueError("vectors of different lengths")
        else:
            sums, cross = sums + s, cross + c
        n += len(vectors)
    if n:
        i, j = np.triu_indices(len(sums))
        d = len(sums)
        rows = np.concatenate([[-2], np.full(d, -1), i]).astype(np.int32)
        cols = np.concatenate([[d], np.arange(d), j]).astype(np.int32)
        values = [Decimal(int(v)) for v in (n, *sums, *cross[i, j])]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])


@dataclass(frozen=True)
class Whitener:
    """``n`` rows with sums ``sums``; unit eigenvectors (rows of ``axes``) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly, as 64-bit integers where they fit and Python integers elsewhere."""
        middle = [round_half(s, self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        far = max(int(np.abs(x - np.array(middle, np.int64)).max(initial=0)), 1)
        kind = np.int64 if self.n * (far + 1) < 2**62 else object
        return self.n * (x - np.array(middle, np.int64)).astype(kind) - np.array(rest, kind)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates: the centred vector on each axis over the root of its eigenvalue."""
        centred = deviations.astype(np.float64) / self.n
        return centred @ self.axes.T / np.sqrt(self.values)


def round_half(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def squared_lengths(deviations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of squares as 64-bit integers, and where they fit into a long.

    Integer arithmetic wraps modulo 2^64, so a sum below 2^63 is right whatever its parts
    do; sums too near to 2^63 to tell by doubles are made of Python integers.
    """
    about = (deviations.astype(np.float64) ** 2).sum(axis=1)
    fits = about < _LONG * (1 - 1e-9)
    if deviations.dtype == object:
        out = np.zeros(len(about), np.int64)
        exact = np.flatnonzero(about < _LONG * (1 + 1e-9))
    else:
        out = (deviations * deviations).sum(axis=1)
        exact = np.flatnonzero(~fits & (about < _LONG * (1 + 1e-9)))
    for k in exact:
        total = sum(int(v) ** 2 for v in deviations[k])
        fits[k] = total < _LONG
        out[k] = total if fits[k] else 0
    return out, fits


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitener | None:
    """Fits on all usable vectors; none where there is none.

    Axes whose eigenvalue is not above the rounding of the largest one are left out: they
    have no spread to scale. The driver gets one sum for each pair of dimensions.
    """
    sums = vectors.select(F.col(vector_col)).mapInArrow(_scatter, _PAIR_SCHEMA).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return None
    if any(r["v"] is None for r in sums):
        raise ArithmeticError("sums of more than 38 digits")
    counts = [int(r["v"]) for r in sums if r["i"] == -2]
    if len(counts) > 1:
        raise ValueError("vectors of different lengths")
    n = counts[0]
    total = {r["j"]: int(r["v"]) for r in sums if r["i"] == -1}
    dims = len(total)
    covariance = np.zeros((dims, dims))
    for r in sums:
        i, j = r["i"], r["j"]
        if i >= 0:
            # Python divides integers of any size with one rounding.
            covariance[i, j] = covariance[j, i] = (n * int(r["v"]) - total[i] * total[j]) / n**2
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1].T
    spread = math.fsum(np.diag(covariance))
    keep = np.flatnonzero(values > max(values[0], 0.0) * dims * np.finfo(float).eps)[:components]
    return Whitener(n, tuple(total[d] for d in range(dims)), axes[keep], values[keep], values[keep] / spread if spread else values[keep])


def identity_error(vectors: DataFrame, vector_col: str, whitener: Whitener) -> float:
    """Largest entry of the covariance of all whitened vectors minus the identity, measured in one more pass."""
    k = len(whitener.values)

    def moments(batches):
        sums, cross, seen = np.zeros(k), np.zeros((k, k)), False
        for piece in chunks_of(batches, BLOCK_ROWS):
            _, found = usable(piece.column(0))
            if len(found):
                y = whitener.project(whitener.deviations(quantized(found)))
                sums, cross, seen = sums + y.sum(axis=0), cross + y.T @ y, True
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(k, -1), i]).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k), j]).astype(np.int32)),
                    pa.array(np.concatenate([sums, cross[i, j]])),
                ],
                ["i", "j", "v"],
            )

    rows = vectors.select(F.col(vector_col)).mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r["j"]: r["v"] / whitener.n for r in rows if r["i"] == -1}
    return max((abs(r["v"] / whitener.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["i"] >= 0), default=0.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each usable vector and component.

    ``(id_col, component, n, deviation, whitened, explained, identity_error)``: component
    numbers start at 1 by falling eigenvalue; ``deviation`` is the sum over dimensions of
    ``(n * x - S)^2``, null where that is no long.

    Null and empty vectors and those with null or non-finite entries are dropped. A null id
    stays null and repeated rows are repeated in the result; each counts in the fit. Where
    fewer than ``components`` axes have any spread (few rows, equal rows, constant
    dimensions), only those are returned; an empty table or one whose vectors are all equal
    gives no rows. Other columns are not read. Vectors of different lengths, and entries too
    large for 64-bit integers, are errors.
    """
    schema = f"__id {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double"
    fitted = fit(vectors, vector_col, components)
    k = 0 if fitted is None else len(fitted.values)
    error = identity_error(vectors, vector_col, fitted) if k else 0.0

    def project(batches):
        for piece in chunks_of(batches, BLOCK_ROWS):
            rows, found = usable(piece.column(1))
            if not k or not len(rows):
                continue
            away = fitted.deviations(quantized(found))
            lengths, fits = squared_lengths(away)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), fitted.n, np.int64)),
                    pa.array(lengths[each], mask=~fits[each]),
                    pa.array(fitted.project(away).ravel()),
                    pa.array(np.tile(fitted.explained, len(rows))),
                ],
                ["__id", "component", "n", "deviation", "whitened", "explained"],
            )

    out = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector")).mapInArrow(project, schema)
    return out.withColumnRenamed("__id", id_col).withColumn("identity_error", F.lit(error))
