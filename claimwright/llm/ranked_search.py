"""Ranked lexical search by the Best Position Algorithm.

Documents become postings of the searched terms: one row a document, with its length. Each
task then makes impact lists of the documents it holds, block by block, sorted by falling
impact, and answers all items on them: sorted access goes down every list of an item; each
document met is scored at once by direct access to its own postings, which also marks its
place in the other lists as seen. The best position of a list is the end of the seen run
at its top, often well below the last row read in order. No unseen document can score above
the sum of the impacts that follow the best positions; an item is done when that sum is
strictly below its k-th score, so ties are never lost. The k-th score is carried on from
block to block of a task, and tasks send at most ``k`` rows an item to the final ranking.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from claimwright.llm import textbytes
from claimwright.session import settle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Pairs of item and term that a task holds at once; more items are searched in further passes.
BLOCK_PAIRS = 200_000
#: Documents and postings of one block of impact lists; bounds a task's memory.
BLOCK_DOCS = 20_000
BLOCK_POSTINGS = 2_000_000
#: Rows of each list in the first round of sorted access; doubled in every further round.
FIRST_DEPTH = 64


@dataclass(frozen=True)
class Vocabulary:
    """Distinct terms, found in texts by a hash and then compared byte by byte."""

    terms: list[str]
    order: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        data, offsets = textbytes.joined(pa.array(terms, pa.string()))
        words = textbytes.Words(data, offsets, textbytes.ascii_folded)
        order = np.argsort(words.hash)
        hashes = words.hash[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ArithmeticError("two terms share a 64-bit hash")
        return cls(terms, order, hashes, words.data, words.start, words.size)

    def find(self, words: textbytes.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` that hold one of the terms, and which."""
        if not len(self.hashes) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == words.hash)
        term = self.order[near[at]]
        same = self.size[term] == words.size[at]
        at, term = at[same], term[same]
        if len(at):
            size = self.size[term]
            ends = np.cumsum(size)
            inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
            equal = words.data[np.repeat(words.start[at], size) + inner] == self.data[np.repeat(self.start[term], size) + inner]
            same = np.logical_and.reduceat(equal, ends - size)
            at, term = at[same], term[same]
        return at, term


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """How often each item holds each term: ``(__item, term, times)``; rows of one id are one item."""

    def count(batches):
        for batch in batches:
            ids, rows, terms = batch.column(0), [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = TERM.findall((text or "").translate(_LOWER))
                rows += [k] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], ["__item", "term"])

    rows = items.select(F.col(item_col).alias("__item"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(count, f"__item {dict(items.dtypes)[item_col]}, term string").groupBy("__item", "term").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """For each document with a term: its number of terms, and the terms of the vocabulary with their counts."""
    width = max(len(vocabulary.terms), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in textbytes.chunks(batch.column(1)):
                piece = batch.slice(at, end - at)
                words = textbytes.Words(*textbytes.joined(piece.column(1)), textbytes.ascii_folded)
                sizes = np.diff(words.first)
                places, term = vocabulary.find(words)
                doc = np.searchsorted(words.first, places, "right") - 1
                keys, counts = np.unique(doc * width + term, return_counts=True)
                rows = np.flatnonzero(sizes)
                cuts = np.searchsorted(keys, np.append(rows, len(sizes)) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in ((keys % width).astype(np.int32), counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows)), pa.array(sizes[rows].astype(np.int64)), *lists], ["__id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return texts.mapInArrow(read, "__id long, n long, terms array<int>, tfs array<bigint>")


def statistics(posted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term the documents that hold it."""

    def count(batches):
        docs, length, df = 0, 0, np.zeros(terms, np.int64)
        for batch in batches:
            docs += batch.num_rows
            length += int(batch.column(0).to_numpy().sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], held]).astype(np.int64)), pa.array(np.concatenate([[docs, length], df[held]]))], ["k", "v"]
        )

    rows = posted.select("n", "terms").mapInArrow(count, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    of = {r["k"]: r["v"] for r in rows}
    df = np.zeros(terms, np.int64)
    for k, v in of.items():
        if k >= 0:
            df[k] = v
    return of.get(-2, 0), of.get(-1, 0), df


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    """``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` in integers."""
    kind = np.int64 if 75 * int(n.max(initial=0)) * docs < 2**63 else object
    m = (100 - 75 + (75 * n.astype(kind) * docs) // max(length, 1)).astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class ImpactLists:
    """The lists of one block of documents.

    Postings are kept once by term and falling impact (sorted access) and once by document
    (direct access); ``place`` leads from the second order to the first.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        worth = impact > 0
        doc, term, impact = doc[worth], term[worth], impact[worth]
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        self.of_doc, self.term = np.searchsorted(doc, np.arange(docs + 1)), term
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.own = impact
        self.docs = docs


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Best:
    """The ``k`` best ``(score, id)`` so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, null: np.ndarray, id_: np.ndarray) -> None:
        may = score >= max(self.kth(), 1)
        if may.any():
            score, null, id_ = (np.concatenate(x) for x in ((self.score, score[may]), (self.null, null[may]), (self.id, id_[may])))
            top = np.lexsort((id_, null, -score))[: self.k]
            self.score, self.null, self.id = score[top], null[top], id_[top]


def best_positions(lists: ImpactLists, terms: np.ndarray, times: np.ndarray, null: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Brings ``best`` up to date with the documents of one block for one item; returns how many were scored."""
    start, end = lists.start[terms], lists.start[terms + 1]
    some = end > start
    start, end, terms, times = start[some], end[some], terms[some], times[some]
    if not len(terms):
        return 0
    weight = np.zeros(len(lists.start), np.int64)
    weight[terms] = times
    seen = np.zeros(len(lists.doc), bool)
    met = np.zeros(lists.docs, bool)
    read, depth = start.copy(), FIRST_DEPTH
    while True:
        down = np.minimum(start + depth, end)
        doc = lists.doc[_ranges(read, np.maximum(down, read))]
        new = np.unique(doc[~met[doc]])
        if len(new):
            met[new] = True
            first, last = lists.of_doc[new], lists.of_doc[new + 1]
            own = _ranges(first, last)
            factor = weight[lists.term[own]]
            seen[lists.place[own[factor > 0]]] = True
            # Every document met holds a term, so no range is empty.
            score = np.add.reduceat(factor * lists.own[own], np.concatenate([[0], np.cumsum(last - first)[:-1]]))
            best.add(score, null[new], ids[new])
        bound = 0
        for k in range(len(terms)):
            at = max(down[k], read[k])
            if at < end[k]:
                run = seen[at : end[k]]
                gap = int(run.argmin())
                at = end[k] if run[gap] else at + gap
                if at < end[k]:
                    bound += int(times[k]) * int(lists.impact[at])
            read[k] = at
        if bound == 0 or (len(best.score) == best.k and bound < best.kth()):
            return int(met.sum())
        depth = max(2 * depth, int((read - start).min()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            piece = batch.slice(at, BLOCK_DOCS)
            held.append(piece)
            rows += piece.num_rows
            size += len(piece.column(2).flatten())
            if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search_block(docs: DataFrame, wanted: list, item_type: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """Best rows of each task for one bounded set of items: ``(__item, doc_id, score)``."""
    vocabulary = Vocabulary.of(sorted({r["term"] for r in wanted}))
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    items: dict = {}
    for r in wanted:
        items.setdefault(r["__item"], []).append((number[r["term"]], r["times"]))
    posted = settle(postings(docs, vocabulary, id_col, text_col))
    n_docs, length, df = statistics(posted, len(vocabulary.terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    searches = [(i, *(np.array(v, np.int64) for v in zip(*sorted(p)))) for i, p in items.items()]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((searches, weight))
    item_arrow = spark.createDataFrame([], f"x {item_type}").toArrow().schema.field("x").type

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, weight = shared.value
        found = [Best(k) for _ in searches]
        for block in _blocks(batches):
            n, terms = block.column("n").to_numpy(), block.column("terms").combine_chunks()
            sizes = terms.value_lengths().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), sizes)
            term = terms.flatten().to_numpy().astype(np.int64)
            tf = block.column("tfs").combine_chunks().flatten().to_numpy()
            lists = ImpactLists(doc, term, impacts(tf, n[doc], weight[term], n_docs, length), len(n), len(weight))
            id_ = block.column("__id").combine_chunks()
            null, ids = id_.is_null().to_numpy(zero_copy_only=False), id_.fill_null(0).to_numpy()
            for (_, own, times), best in zip(searches, found):
                best_positions(lists, own, times, null, ids, best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s[0] for s, b in zip(searches, found) for _ in b.score], item_arrow),
                pa.array(np.concatenate([b.id for b in found]), mask=np.concatenate([b.null for b in found])),
                pa.array(np.concatenate([b.score for b in found])),
            ],
            ["__item", "doc_id", "score"],
        )

    return posted.mapInArrow(search, f"__item {item_type}, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` best documents of each item: ``(item_col, rank, doc_id, score)``, ids as longs.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, only A-Z
    lower-cased. A null or empty text has no terms; a document without terms doesn't count
    among the documents, and an item without terms or hits gives no row. Equal scores rank
    by smaller id, a null id last. Repeated document rows each count and may each be ranked;
    items that share an id (null included) are one item with the terms of all their rows.
    An empty table on either side gives no rows. Other columns are not read.
    """
    item_type = dict(items.dtypes)[item_col]
    terms = settle(item_terms(items, item_col, item_text_col))
    pairs = terms.count()
    blocks = -(-pairs // BLOCK_PAIRS)
    part = F.pmod(F.xxhash64(F.struct("__item")), F.lit(max(blocks, 1)))
    found = docs.sparkSession.createDataFrame([], f"__item {item_type}, doc_id long, score long")
    for b in range(blocks):
        wanted = terms.where(part == b).collect()
        if wanted:
            own = _search_block(docs, wanted, item_type, k, id_col, text_col)
            found = own if b == 0 else found.unionAll(own)
    rank = F.row_number().over(Window.partitionBy("__item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("__item").alias(item_col), "rank", "doc_id", "score")
