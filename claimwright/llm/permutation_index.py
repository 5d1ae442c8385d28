"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order of nearness. Shards of rows post
the vectors in pivot inverted files: for each pivot, the rows that have it among their
``KEPT`` nearest, with its place in their order. A query reads the lists of its ``ASKED``
nearest pivots, which sums up to each row's footrule distance on those pivots; the rows
of least distance are reranked by the exact inner product.

Largest inner product becomes smallest angle: with ``M`` the largest norm, a row ``x``
stands for the unit vector ``(x / M, sqrt(1 - |x|^2 / M^2))`` and a query for ``(q / |q|, 0)``.

What share of a shard is reranked is measured, not fixed: probe queries, a bounded sample,
are first answered exactly against all rows, and the share is where the wanted part of their
true neighbours is found. Shards and blocks of queries are of bounded size, so no task
grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from claimwright.llm.vectors import chunks_of, usable

#: Pivots, at most; of these, how many a row keeps and how many of its own a query asks.
PIVOTS, KEPT, ASKED = 256, 128, 32
#: Rows looked at for pivots, chosen by hash.
PIVOT_SAMPLE = 1024
#: Queries whose true neighbours set the share to rerank, and the part of these to be found.
PROBES, WANTED = 256, 0.96
#: Rows of a shard and queries of a block, on average.
SHARD_ROWS, QUERY_ROWS = 8192, 8192
#: Rows reranked at once for one query.
RERANK_ROWS = 4096

_ROW = "id long, vector binary, places binary"


@dataclass(frozen=True)
class Pivots:
    """Pivots as rows of ``vectors`` with their last, added coordinate ``lift``; ``norm`` is the largest of all rows."""

    vectors: np.ndarray
    lift: np.ndarray
    norm: float

    @classmethod
    def of(cls, vectors: np.ndarray, norm: float) -> Pivots:
        return cls(vectors, lifted(vectors, norm), norm)

    def order(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Pivots of each vector from near to far; equally near ones by number."""
        near = (vectors / self.norm) @ (self.vectors / self.norm).T
        if not queries:
            near += lifted(vectors, self.norm)[:, None] * self.lift[None, :]
        return np.argsort(-near, axis=1, kind="stable")


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    return np.sqrt(np.maximum(1 - ((vectors / norm) ** 2).sum(axis=1), 0))


def kept_of(pivots: int) -> int:
    return min(KEPT, max(pivots // 2, 1))


def places(order: np.ndarray, pivots: int) -> np.ndarray:
    """For each pivot its place in the order of each row; the number kept where it is further off."""
    kept = kept_of(pivots)
    out = np.full((len(order), pivots), kept, np.uint8)
    np.put_along_axis(out, order[:, :kept], np.arange(kept, dtype=np.uint8)[None, :], axis=1)
    return out


class InvertedFiles:
    """The posting lists of one shard: for each pivot its rows and what each gains over a row not listed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places_: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        table = places_[order]
        self.pivots = table.shape[1]
        self.kept = kept_of(self.pivots)
        self.asked = min(ASKED, self.kept)
        pivot, row = np.nonzero(table.T < self.kept)
        self.rows = row.astype(np.int32)
        self.places = np.ascontiguousarray(table.T[pivot, row]).astype(np.int16)
        self.first = np.searchsorted(pivot, np.arange(self.pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Of every row, the sum over the query's nearest pivots of how far their places differ."""
        far = self.kept - np.arange(self.asked)
        total = np.full(len(self.ids), int(far.sum()), np.int32)
        for i, p in enumerate(order[: self.asked]):
            a, b = self.first[p], self.first[p + 1]
            total[self.rows[a:b]] += np.abs(self.places[a:b] - np.int16(i)) - np.int16(far[i])
        return total

    def nearest(self, query: np.ndarray, own: int, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the ``k`` best found, their scores, and their place by footrule as a share of the shard.

        Rows with the query's own id take no part. Equal distances go by smaller id.
        """
        key = self.footrule(order).astype(np.int64) * len(self.ids) + np.arange(len(self.ids))
        low, high = np.searchsorted(self.ids, [own, own + 1]) if own < np.iinfo(np.int64).max else (np.searchsorted(self.ids, own), len(self.ids))
        others = len(key) - (high - low)
        key[low:high] = np.iinfo(np.int64).max
        take = min(max(int(np.ceil(share * len(key))), k), others)
        if not take:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        rows = np.argpartition(key, take - 1)[:take] if take < len(key) else np.arange(len(key))
        score = np.concatenate([(self.vectors[rows[a : a + RERANK_ROWS]] * query).sum(axis=1) for a in range(0, take, RERANK_ROWS)])
        if take > k:
            # All rows at the k-th score stay, so that ties are settled by id.
            good = np.flatnonzero(score >= np.partition(score, take - k)[take - k])
            rows, score = rows[good], score[good]
        best = np.lexsort((rows, -score))[:k]
        rows, score = rows[best], score[best]
        return rows, score, (key <= key[rows][:, None]).sum(axis=1) / len(key) if share >= 1 else np.zeros(len(rows))


def _packed(table: np.ndarray) -> pa.Array:
    width = table.shape[1] * table.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(table), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), -1)


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and vectors as ``(__id, __vector)``, without those that take no part."""
    v = F.col("__vector")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__vector"))
    return rows.where(v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0))


def represented(rows: DataFrame, pivots: Pivots, queries: bool = False) -> DataFrame:
    """``(id, vector, places)``; for queries ``places`` holds the order of pivots instead."""

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks_of(batches, SHARD_ROWS):
            at, found = usable(piece.column(1))
            if len(at):
                order = pivots.order(found, queries)
                table = order.astype(np.uint8) if queries else places(order, len(pivots.vectors))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at)), _packed(found), _packed(table)], ["id", "vector", "places"])

    return rows.mapInArrow(represent, _ROW)


def _shard(table: pa.Table) -> InvertedFiles:
    return InvertedFiles(table.column("id").combine_chunks().fill_null(0).to_numpy(), _unpacked(table.column("vector"), np.float64), _unpacked(table.column("places"), np.uint8))


def _found(queries: list[int], parts: list[tuple]) -> pa.Table:
    ids, scores, ranks = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    sizes = [len(p[0]) for p in parts]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(np.array(queries, np.int64), sizes)),
            "vec_id": pa.array(ids.astype(np.int64)),
            "score": pa.array(scores.astype(np.float64)),
            "place": pa.array(ranks.astype(np.float64)),
        }
    )


_FOUND = "query_id long, vec_id long, score double, place double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def share_to_rerank(shards: DataFrame, probes: list, pivots: Pivots, k: int, wanted: float) -> float:
    """The least share of a shard, by footrule, that holds the wanted part of the probes' true neighbours."""
    vectors = np.array([p["__vector"] for p in probes], np.float64)
    asked = list(zip([p["__id"] for p in probes], vectors, pivots.order(vectors, True)))

    def exact(table: pa.Table) -> pa.Table:
        lists = _shard(table)
        parts = []
        for own, query, order in asked:
            rows, score, place = lists.nearest(query, own, order, k, 1.0)
            parts.append((lists.ids[rows], score, place))
        return _found([a[0] for a in asked], parts)

    found = best_of(shards.groupBy("shard").applyInArrow(exact, _FOUND), k)
    needed = sorted(r["place"] for r in found.select("place").collect())
    return needed[min(int(np.ceil(wanted * len(needed))), len(needed)) - 1] if needed else 1.0


def neighbours(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    wanted: float = WANTED,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each row whose id is divisible by ``every`` its ``k`` nearest others: ``(query_id, rank, vec_id, score)``.

    ``score`` is the inner product of the original vectors in double precision; nearest
    first, ties to the smaller id. Vectors that are null, empty, all zero or hold null or
    non-finite entries take no part, nor do rows with a null id. Rows that repeat an id are
    all candidates, for every query but that of the id itself; as a query an id
    counts once, with its smallest vector. Fewer than ``k`` candidates are all returned; an empty table gives no rows. Other
    columns are not read. Vectors of different lengths are an error.
    """
    spark = vectors.sparkSession
    rows = usable_rows(vectors, id_col, vector_col).where(F.col("__id").isNotNull())
    squares = F.aggregate("__vector", F.lit(0.0), lambda a, c: a + c * c)
    size = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("norm"), F.min(F.size("__vector")).alias("low"), F.max(F.size("__vector")).alias("high")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size["low"] != size["high"]:
        raise ValueError("vectors of different lengths")
    by_hash = lambda seed: F.xxhash64("__id", "__vector", F.lit(seed))
    sample = np.array([r["__vector"] for r in rows.orderBy(by_hash(1), "__id").limit(PIVOT_SAMPLE).collect()], np.float64)
    _, first = np.unique(sample, axis=0, return_index=True)
    pivots = Pivots.of(sample[np.sort(first)[:PIVOTS]], size["norm"])

    n_shards, n_queries = -(-size["n"] // shard_rows), rows.where(F.col("__id") % every == 0).count()
    blocks = max(-(-n_queries // query_rows), 1)
    shards = represented(rows, pivots).withColumn("shard", F.floor(F.rand(7) * n_shards).cast("int"))
    probes = rows.orderBy(by_hash(2), "__id").limit(PROBES).collect()
    share = share_to_rerank(shards, probes, pivots, k, wanted)

    each = rows.where(F.col("__id") % every == 0).groupBy("__id").agg(F.min("__vector").alias("__vector"))
    asked = represented(each, pivots, queries=True).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    posted = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else shards.withColumn("block", F.lit(0))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def search(table: pa.Table, queries: pa.Table) -> pa.Table:
        if not table.num_rows or not queries.num_rows:
            return _found([], [])
        lists = _shard(table)
        ids = queries.column("id").to_pylist()
        parts = []
        for own, query, order in zip(ids, _unpacked(queries.column("vector"), np.float64), _unpacked(queries.column("places"), np.uint8)):
            rows, score, place = lists.nearest(query, own, order, k, share)
            parts.append((lists.ids[rows], score, place))
        return _found(ids, parts)

    found = posted.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, _FOUND)
    return best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
