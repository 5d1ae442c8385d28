"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of hashed word shingles. A forest of prefix tries holds their MinHash
signatures: each tree orders the texts by a path of minima, so texts that share a
prefix are neighbours. Sorting by (tree, path) lays all tries out at once, and one
pass over the sorted rows links each text to its neighbour and to the first text of
its node at each depth, if their signatures agree enough. Links record the depth of the
shared prefix; prefixes are then shortened from the longest until the estimated recall
of similar pairs reaches the target.

Links only gather texts into candidate groups. A group of more than one block, such as
the pages of a site around one frame, is first cut by prefix filtering: similar texts share
one of their rarest shingles, so texts that share none of them part without losing a link. In a
group every pair is verified on the exact shingle sets, block against block, so no group is held in one task, no pair
is written, and what leaves a task is linear in its texts: link counts and a spanning
forest of the true links.

Equal word sequences are one vertex throughout, with a count of its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm import bloom, textbytes
from claimwright.llm.common import salted, text_or_empty
from claimwright.llm.components import components
from claimwright.llm.words import Words
from claimwright.session import settle

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, FLOOR = 16, 6, 4
VALUES = TREES * DEPTH
BLOCK = 256
SALTS = 16
#: Signatures that agree less than this far below the threshold are no candidates: at
#: 96 values seven standard errors.
SLACK = 0.3
#: Counters of the sketch that orders shingles from rare to frequent.
COUNTERS = 1 << 20

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, (2, VALUES), np.uint64).astype(np.uint32) | np.uint32(1)


class Shingles:
    """Distinct hashed shingles of each text, ascending; texts of fewer words have one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = WORDS):
        words = Words(data, offsets)
        n = len(offsets) - 1
        self.count = np.diff(words.first)
        h = words.hash
        # The whole sequence of words as one number: equal texts are one vertex.
        owner = np.repeat(np.arange(n), self.count)
        place = np.arange(len(h)) - np.repeat(words.first[:-1], self.count)
        powers = textbytes.powers_to(int(self.count.max(initial=0)) + 1)
        self.vertex = np.zeros(n, np.uint64)
        filled = np.flatnonzero(self.count)
        if len(h):
            self.vertex[filled] = textbytes.mix(np.add.reduceat(h * powers[place], words.first[:-1][filled]))
        rolled = h.copy()
        for k in range(1, size):
            rolled = textbytes.mix(rolled[: len(rolled) - 1] + np.uint64(k)) + h[k:] if len(rolled) > 1 else rolled[:0]
        whole = np.flatnonzero(place[: len(rolled)] + size <= self.count[owner[: len(rolled)]])
        short = np.flatnonzero((self.count > 0) & (self.count < size))
        every = np.concatenate([rolled[whole], self.vertex[short]])
        owners = np.concatenate([owner[whole], short])
        order = np.lexsort((every, owners))
        every, owners = every[order], owners[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (owners[1:] != owners[:-1])
        self.hash, owners = every[new], owners[new]
        self.first = np.searchsorted(owners, np.arange(n + 1))

    def signatures(self) -> np.ndarray:
        """Minima of ``VALUES`` hash functions, 32 bits each; zeros for a text without words."""
        out = np.zeros((len(self.first) - 1, VALUES), np.uint32)
        filled = np.flatnonzero(np.diff(self.first))
        if len(filled):
            x = (self.hash >> np.uint64(32)).astype(np.uint32)
            starts = self.first[:-1][filled]
            for k in range(VALUES):
                y = x * _MULTIPLY[0, k]
                y ^= y >> np.uint32(16)
                y *= _MULTIPLY[1, k]
                out[filled, k] = np.minimum.reduceat(y, starts)
        return out


def path_levels(values: np.ndarray) -> np.ndarray:
    """16 bits of a hash over all 32 bits of each minimum, one level of a path each.

    Minima of long texts are small numbers, so their own leading bits say nothing.
    """
    y = values ^ (values >> np.uint32(16))
    y = y * np.uint32(0x85EBCA6B)
    y ^= y >> np.uint32(13)
    y *= np.uint32(0xC2B2AE35)
    return (y >> np.uint32(16)).astype(">u2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in textbytes.chunks(batch.column(1)):
            part = batch.slice(low, high - low)
            shingles = Shingles(*textbytes.joined(part.column(1)))
            values = shingles.signatures()
            paths = path_levels(values)
            marks = (values & np.uint32(255)).astype(np.uint8)
            has = shingles.count > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(shingles.vertex.view(np.int64), mask=~has),
                    pa.array([p.tobytes() if ok else None for p, ok in zip(paths, has)], pa.binary()),
                    pa.array([m.tobytes() if ok else None for m, ok in zip(marks, has)], pa.binary()),
                ],
                ["id", "vertex", "path", "marks"],
            )


def _neighbours(floor: int, depth: int, least: float):
    """Links within sorted tries; the first and last row of a task come out as border rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before the batch
        heads: dict[int, tuple] = {}  # by depth, the first row of the node that is open
        border: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            tree = batch.column(0).to_numpy()
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, depth)
            vertex = batch.column(2).to_numpy()
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, VALUES)
            if last is None:
                border.append((int(tree[0]), path[0].tobytes(), int(vertex[0]), marks[0].tobytes()))
                last = (-1, path[0], vertex[0], marks[0])
            t = np.concatenate([[last[0]], tree])
            p = np.concatenate([last[1][None], path])
            v = np.concatenate([[last[2]], vertex])
            m = np.concatenate([last[3][None], marks])
            same = (p[1:] == p[:-1]) & (t[1:] == t[:-1])[:, None]
            shared = np.cumprod(same, axis=1).sum(1)
            rows = np.arange(1, n + 1)
            found = []

            def link(own, other_v, other_m, level):
                alike = (m[own] == other_m).mean(1)
                good = (alike >= least) & (v[own] != other_v)
                found.append((v[own][good], other_v[good], level[good], alike[good]))

            near = rows[shared >= floor]
            link(near, v[near - 1], m[near - 1], shared[near - 1])
            for d in range(floor, depth + 1):
                start = np.maximum.accumulate(np.where(shared < d, rows, 0))
                own = rows[(shared >= d) & (start < rows - 1)]
                at = start[own - 1]
                inside = at > 0
                link(own[inside], v[at[inside]], m[at[inside]], np.full(int(inside.sum()), d))
                if d in heads and (~inside).any():
                    out = own[~inside]
                    link(out, np.full(len(out), heads[d][0]), np.broadcast_to(heads[d][1], (len(out), VALUES)), np.full(len(out), d))
                if start[-1] > 0:
                    heads[d] = (v[start[-1]], m[start[-1]].copy())
            last = (int(tree[-1]), path[-1].copy(), vertex[-1], marks[-1].copy())
            a, b, level, alike = (np.concatenate(x) for x in zip(*found))
            yield _links(np.maximum(a, b), np.minimum(a, b), level, alike)
        if last is not None:
            border.append((last[0], last[1].tobytes(), int(last[2]), last[3].tobytes()))
            none = [None] * len(border)
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, pa.int64())] * 2 + [pa.array(none, pa.int32()), pa.array(none, pa.float64())]
                + [pa.array(c, k) for c, k in zip(zip(*border), (pa.int32(), pa.binary(), pa.int64(), pa.binary()))],
                ["u", "v", "depth", "alike", "tree", "path", "vertex", "marks"],
            )

    def _links(u, v, level, alike):
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u), pa.array(v), pa.array(level, pa.int32()), pa.array(alike), pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
            ["u", "v", "depth", "alike", "tree", "path", "vertex", "marks"],
        )

    return run


_LINK_SCHEMA = "u bigint, v bigint, depth int, alike double, tree int, path binary, vertex bigint, marks binary"


def trie_links(signed: DataFrame, similarity: float) -> DataFrame:
    """``(u, v, depth, alike)`` between neighbours in the tries; linear in the texts."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = signed.select("vertex", "path", "marks", tree.alias("tree")).select(
        "tree", F.expr(f"substring(path, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("path"), "vertex", "marks"
    )
    order = ("tree", "path", "vertex")
    run = _neighbours(FLOOR, DEPTH, similarity - SLACK)
    passed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _LINK_SCHEMA))
    # Where a node spans tasks: the border rows, two a task, once more in one task.
    border = passed.where("tree is not null").select("tree", "path", "vertex", "marks")
    across = border.repartition(1).sortWithinPartitions(*order).mapInArrow(run, _LINK_SCHEMA)
    return passed.where("u is not null").select("u", "v", "depth", "alike").unionAll(
        across.where("u is not null").select("u", "v", "depth", "alike")
    )


def shared_at(similarity, depth: int):
    """Probability that two texts share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def choose_depth(links: DataFrame, similarity: float, target: float) -> int:
    """The longest prefix whose estimated recall of similar pairs reaches the target.

    Every pair seen counts for one over the probability of being seen at the shortest
    prefix; recall at a depth is the share of that total that shares so long a prefix.
    """
    pairs = links.where(F.col("alike") >= similarity).groupBy("u", "v").agg(F.max("depth").alias("depth"), F.max("alike").alias("alike"))
    chance = shared_at(F.col("alike"), FLOOR)
    seen = {r["depth"]: (r["n"], r["whole"]) for r in pairs.groupBy("depth").agg(F.count("*").alias("n"), F.sum(1 / chance).alias("whole")).collect()}
    whole = sum(w for _, w in seen.values())
    for depth in range(DEPTH, FLOOR, -1):
        if sum(n for d, (n, _) in seen.items() if d >= depth) >= target * whole and shared_at(similarity, depth) >= target:
            return depth
    return FLOOR


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in textbytes.chunks(batch.column(1)):
            part = batch.slice(low, high - low)
            s = Shingles(*textbytes.joined(part.column(1)))
            sets = [s.hash[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:])]
            has = s.count > 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(s.vertex.view(np.int64), mask=~has), pa.array(sets, pa.binary())], ["id", "vertex", "shingles"]
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of a task fall on each counter of the sketch."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        total += np.bincount((flat >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    for low in range(0, len(at), 1 << 16):
        part = at[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["counter", "n"])


def rarest(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles, so many that similar sets have one of them in common.

    Sets of Jaccard similarity ``s`` share ``s n`` shingles of each, so in any one order of all
    shingles their first ``n - ceil(s n) + 1`` meet. Counts only make the order a selective one.
    """
    n = len(shingles)
    keep = n - int(np.ceil(similarity * n - 1e-6)) + 1
    return shingles[np.lexsort((shingles, counts[(shingles >> np.uint64(44)).astype(np.int64)]))[:keep]]


def _rare(counts, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [rarest(np.frombuffer(s, np.uint64), counts.value, similarity) for s in part.column(2).to_pylist()]
                size = [len(s) for s in sets]
                root = np.repeat(part.column(1).to_numpy().view(np.uint64), size)
                token = textbytes.mix(np.concatenate(sets) ^ root)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(token.view(np.int64))], ["vertex", "token"]
                )

    return run


def split_groups(sets: DataFrame, similarity: float) -> DataFrame:
    """``(vertex, root)``: groups cut into ones whose texts share rare shingles; lone texts go.

    ``sets`` holds ``vertex, root, shingles``. Similar texts of a group stay together. What
    is sent is a sketch of ``COUNTERS`` counts; a shingle's texts meet in partial minima only.
    """
    context = sets.sparkSession.sparkContext
    counts = np.zeros(COUNTERS, np.int64)
    seen = sets.select("shingles").mapInArrow(_counted, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    known = seen.where("n > 1").toArrow()
    counts[known.column("counter").to_numpy()] = known.column("n").to_numpy()
    rows = settle(sets.select("vertex", "root", "shingles").mapInArrow(_rare(context.broadcast(counts), similarity), "vertex bigint, token bigint"))
    shared = rows.groupBy("token").agg(F.min("vertex").alias("v"), F.max("vertex").alias("last")).where("v < last").select("token", "v")
    dealt = rows.withColumn("__salt", F.pmod("vertex", F.lit(SALTS)).cast("int"))
    return components(dealt.join(salted(shared, SALTS), ["token", "__salt"]).select(F.col("vertex").alias("u"), "v"))


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of shingle sets have at least that Jaccard similarity."""
    n = len(left)
    sets = left + right
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    known, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        here = np.zeros((len(sets), 4096), np.float32)
        here[owner[a:b], column[a:b] - low] = 1
        common += here[:n] @ here[n:].T
    either = size[:n, None] + size[None, n:] - common
    return common >= similarity * either - 1e-6


def _verify(similarity: float):
    """Block pairs, sorted by group: link counts of each text and a spanning forest."""

    def settle_group(rows: list[tuple]) -> Iterator[tuple]:
        (_, b1, b2), blocks = rows[0][0], {}
        for _, block, vertex, copies, shingles in rows:
            blocks.setdefault(block, {})[vertex] = (copies, np.frombuffer(shingles, np.uint64))
        left, right = blocks.get(b1, {}), blocks.get(b2, {})
        if not left or not right:
            return
        lv, rv = np.array(list(left)), np.array(list(right))
        linked = similar([s for _, s in left.values()], [s for _, s in right.values()], similarity)
        if b1 == b2:
            np.fill_diagonal(linked, False)
        sides = [(lv, linked, right)] if b1 == b2 else [(lv, linked, right), (rv, linked.T, left)]
        for own, link, others in sides:
            copies = np.array([c for c, _ in others.values()], np.int64)
            texts, docs = link.sum(1), link.astype(np.int64) @ copies
            for k in np.flatnonzero(texts):
                yield int(own[k]), int(texts[k]), int(docs[k]), None, None
        label_l, label_r = lv.copy(), rv.copy()
        far = np.iinfo(np.int64).max
        while True:  # the smallest label spreads along the links
            new_l = np.minimum(label_l, np.where(linked, label_r[None], far).min(1))
            new_r = np.minimum(label_r, np.where(linked, new_l[:, None], far).min(0))
            if (new_l == label_l).all() and (new_r == label_r).all():
                break
            label_l, label_r = new_l, new_r
        for v, label in ((lv, label_l), (rv, label_r)):
            for k in np.flatnonzero(v != label):
                yield None, None, None, int(v[k]), int(label[k])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vertex", "texts", "docs", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            group = zip(*(batch.column(c).to_pylist() for c in ("root", "b1", "b2")))
            for key, *rest in zip(group, *(batch.column(c).to_pylist() for c in ("block", "vertex", "copies", "shingles"))):
                if rows and rows[0][0] != key:
                    out += settle_group(rows)
                    rows = []
                rows.append((key, *rest))
            yield batch_of(out)
        if rows:
            yield batch_of(list(settle_group(rows)))

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    target_recall: float = 0.999,
    block: int = BLOCK,
    bloom_blocks: int = bloom.MAX_BLOCKS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, class_id, n_links, n_texts``.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``similarity``; words are runs of letters and digits, case
    folded, as in ``words``: by Unicode class, and single characters in scripts without
    spaces. A text of fewer words is one shingle. ``n_links`` counts the linked
    documents and ``n_texts`` the linked texts other than the document's own word
    sequence. ``class_id`` is the smallest id of the documents that links connect; null
    ids count as members and stay null only where all ids of a class are null. A text
    without words, null or empty, links to nothing and has its own id. Repeated rows
    link like copies. Extra columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    signed = settle(read.mapInArrow(_sign, f"id {id_type}, vertex bigint, path binary, marks binary"))
    texts = settle(signed.where("vertex is not null").groupBy("vertex").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    first = signed.join(
        texts.select(F.col("vertex").alias("__vertex"), F.col("rep")),
        (F.col("vertex") == F.col("__vertex")) & F.col("id").eqNullSafe(F.col("rep")),
        "left_semi",
    )
    links = settle(trie_links(first.select("vertex", "path", "marks"), similarity))
    depth = choose_depth(links, similarity, target_recall)
    groups = settle(components(links.where(F.col("depth") >= depth).select("u", "v")))
    size = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = settle(groups.join(size, "root").join(texts, "vertex"))

    def sets_of(some: DataFrame) -> DataFrame:
        """The shingles of candidates: only their texts are cut again."""
        filter_ = bloom.build(some.select(F.xxhash64("rep").alias("key")), "key", bloom_blocks)
        maybe = bloom.maybe_listed(read.withColumn("key", F.xxhash64("id")), "key", filter_, bloom_blocks).where("__maybe")
        sets = maybe.select("id", "text").mapInArrow(_sets, f"id {id_type}, vertex bigint, shingles binary")
        member = some.withColumnRenamed("vertex", "__vertex")
        return sets.join(member, (F.col("vertex") == F.col("__vertex")) & F.col("id").eqNullSafe(F.col("rep")))

    large = members.where(F.col("size") > block)
    if not large.isEmpty():
        parts = split_groups(settle(sets_of(large).select("vertex", "root", "shingles")), similarity)
        size = parts.groupBy("root").agg(F.count("*").alias("size"))
        small = members.where(F.col("size") <= block)
        members = settle(small.unionByName(parts.join(size, "root").join(texts, "vertex")))
    members = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    joined = sets_of(members)
    placed = joined.select("root", "vertex", "copies", "shingles", "blocks", F.pmod(F.xxhash64("vertex"), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("__other", other).select(
        "root", F.least("block", "__other").alias("b1"), F.greatest("block", "__other").alias("b2"), "block", "vertex", "copies", "shingles"
    )
    keys = ("root", "b1", "b2")
    checked = settle(
        paired.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_verify(similarity), "vertex bigint, texts bigint, docs bigint, u bigint, v bigint")
    )
    counts = checked.where("vertex is not null").groupBy("vertex").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(checked.where("u is not null").select("u", "v"))

    # Classes of linked texts, then of lone texts with copies; other documents are alone.
    linked = roots.join(texts, "vertex").join(counts, "vertex", "left")
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_text = linked.join(least, "root").select("vertex", "class_id", "texts", "docs", "copies")
    alone = texts.where("copies > 1").join(roots.select("vertex"), "vertex", "left_anti").select(
        "vertex", F.col("rep").alias("class_id"), F.lit(0).cast("bigint").alias("texts"), F.lit(0).cast("bigint").alias("docs"), "copies"
    )
    known = settle(by_text.unionAll(alone)).withColumn("__found", F.lit(True))
    dealt = signed.select("id", "vertex", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("__salt"))
    # Texts without words have no vertex; a vertex of their own keeps them from one task.
    spread = F.coalesce("vertex", F.xxhash64("id", F.lit(7)))
    out = dealt.withColumn("__key", spread).join(
        salted(known, SALTS).withColumnRenamed("vertex", "__vertex").withColumnRenamed("__salt", "__salt2"),
        (F.col("__key") == F.col("__vertex")) & (F.col("__salt") == F.col("__salt2")) & F.col("vertex").isNotNull(),
        "left",
    )
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("__found"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_texts"),
    )
