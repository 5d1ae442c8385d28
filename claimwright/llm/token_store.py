"""Token ids as raw binary shards with a minimal perfect hash index.

Layout of a store, a folder that every executor reaches:

* ``ids-<shard>.bin``: the ids of the shard's documents one after another, raw
  little-endian unsigned integers, 16 bits wide where the vocabulary allows, else 32.
  Documents are in ascending key order within and across shards.
* ``index-<bucket>.npz``: for the keys of one hash bucket a minimal perfect hash and,
  by its numbers, fingerprint, shard, first id and number of ids of the document.

A lookup hashes the key to its bucket, gets its number, compares the fingerprint and
reads one slice of one shard: constant time whatever the number of documents.

Tasks write under a name of their own and rename at the end, and a shard's content
depends on its rows alone, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.llm.common import text_or_empty
from claimwright.llm.mphf import PerfectHash
from claimwright.session import settle

KEYS_PER_BUCKET = 50_000
#: Words, and pieces between spaces, that a worker remembers: about 250 MB in all.
CACHED_WORDS, CACHED_PIECES = 1_000_000, 400_000

#: Characters for which the split below equals the tokenizer's own: ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^ \n{_L}0-9]+|[ \n]+(?![^ \n])|[ \n]+")


def _byte_chars() -> dict[int, int]:
    """The character that stands for a byte in byte-level vocabularies: itself where it can
    be seen, else the next free one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class WordEncoder:
    """Whole-text encoding by the tokenizers library with a cache of words.

    A byte-level vocabulary never merges across the words of its own split, so a text's
    ids are its words' ids in a row. Texts of characters outside ``_PLAIN``, where the
    split could differ, texts that hold an added token, and tokenizers of any other make
    go to the library whole. ``special_as_text`` is the library's
    ``encode_special_tokens``; the store leaves it off, as the library does.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.has_added = re.compile("|".join(re.escape(t.content) for t in added)).search if added else None
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and not pre.get("add_prefix_space")
            and spec["model"]["type"] == "BPE"
        )
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.merges = self.tokenizer.model.tokenize

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, word: str) -> bytes:
        """Ids of one word of the split, by the library's merges alone."""
        tokens = self.merges(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        return np.array([t.id for t in tokens], self.dtype).tobytes()

    def _of_words(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts given as their words."""
        known = self.words
        learned = {w: self._learn(w) for w in {w for words in split for w in words if w not in known}}
        if len(known) + len(learned) <= CACHED_WORDS:
            known.update(learned)
        return [b"".join([known[w] if w in known else learned[w] for w in words]) for words in split]

    def encode(self, text: str) -> bytes:
        if not self.by_word or _PLAIN.fullmatch(text) is None or self.has_added and self.has_added(text):
            return self._whole(text).tobytes()
        if text[:1] == " " or text[-1:] == " " or any(x in text for x in ("  ", " \n", "\n ")):
            return self._of_words([_WORDS.findall(text)])[0]
        # Every space stands between two other characters, so it starts a word: the text
        # falls apart there, and whole pieces are looked up before their words are.
        head, *tail = text.split(" ")
        ids = list(map(self.pieces.get, tail))
        new = {w for w, x in zip(tail, ids) if x is None} if None in ids else set()
        first, *others = self._of_words([_WORDS.findall(head), *(_WORDS.findall(" " + w) for w in new)])
        if new:
            learned = dict(zip(new, others))
            if len(self.pieces) + len(learned) <= CACHED_PIECES:
                self.pieces.update(learned)
            ids = [learned[w] if x is None else x for w, x in zip(tail, ids)]
        return first + b"".join(ids)


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _shard_name(root: str, shard: int) -> str:
    return f"{root}/ids-{shard:08d}.bin"


def _index_name(root: str, bucket: int) -> str:
    return f"{root}/index-{bucket:08d}.npz"


def _shard_writer(folder: str, path: str, end_id: int | None, chunk_chars: int = 4_000_000):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        task = TaskContext.get()
        shard, at, last, rank = task.partitionId(), 0, object(), 0
        fs, root = _open(folder)
        own = f"{root}/.part-{shard}-{task.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                starts, sizes, ranks = [], [], []
                for key, text in zip(batch.column(0), batch.column(1)):
                    ids = encoder.encode(text.as_py()) + end
                    out.write(ids)
                    value = key.as_py()
                    rank = rank + 1 if value == last else 0
                    last = value
                    starts.append(at)
                    sizes.append(len(ids) // width)
                    ranks.append(rank)
                    at += len(ids) // width
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ranks, pa.int64()), pa.array([shard] * n, pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    ["key", "rank", "shard", "first", "n_ids"],
                )
        fs.move(own, _shard_name(root, shard))

    return write


def _index_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        rows = pa.Table.from_batches(read)
        col = {n: rows[n].to_numpy() for n in rows.column_names}
        fs, root = _open(folder)
        order = np.argsort(col["bucket"], kind="stable")
        buckets, starts = np.unique(col["bucket"][order], return_index=True)
        for bucket, own in zip(buckets, np.split(order, starts[1:])):
            first, second = col["hash1"][own].view(np.uint64), col["hash2"][own].view(np.uint64)
            perfect = PerfectHash.build(first, second)
            at = perfect.numbers(first, second)
            columns = {
                "print": second.astype(np.uint32),
                "shard": col["shard"][own].astype(np.uint32),
                "first": col["first"][own].astype(np.uint64),
                "n_ids": col["n_ids"][own].astype(np.uint64),
            }
            data = perfect.dump({k: v[np.argsort(at)] for k, v in columns.items()})
            part = f"{root}/.index-{bucket}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part) as out:
                out.write(data)
            fs.move(part, _index_name(root, int(bucket)))
        sizes = np.diff([*starts, len(order)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array(sizes, pa.int64())], ["bucket", "n_keys"]
        )

    return write


def _index_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        loaded: dict[int, tuple] = {}
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            first = batch.column("hash1").to_numpy().view(np.uint64)
            second = batch.column("hash2").to_numpy().view(np.uint64)
            shard = np.full(len(buckets), -1, np.int32)
            start, n_ids = np.zeros(len(buckets), np.int64), np.zeros(len(buckets), np.int64)
            for bucket in np.unique(buckets):
                if bucket not in loaded:
                    loaded = {bucket: _load_index(fs, root, int(bucket))}  # rows come sorted: one at a time
                perfect, cols = loaded[bucket]
                if perfect is None:
                    continue
                own = np.flatnonzero(buckets == bucket)
                at = perfect.numbers(first[own], second[own])
                good = at >= 0
                good[good] = cols["print"][at[good]] == second[own][good].astype(np.uint32)
                own, at = own[good], at[good]
                shard[own] = cols["shard"][at]
                start[own], n_ids[own] = cols["first"][at], cols["n_ids"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("rank"), pa.array(shard), pa.array(start), pa.array(n_ids)],
                ["key", "rank", "shard", "first", "n_ids"],
            )

    return read


def _load_index(fs, root: str, bucket: int):
    name = _index_name(root, bucket)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None, {}
    with fs.open_input_stream(name) as f:
        return PerfectHash.load(f.read())


def _payload_reader(folder: str, width: int, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        shard, file = -1, None
        dtype = np.dtype(f"<u{width}")
        for batch in batches:
            crcs, ids = [], []
            for own, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n_ids"))):
                if own != shard:
                    if file is not None:
                        file.close()
                    shard, file = own, fs.open_input_file(_shard_name(root, own))
                file.seek(first * width)
                values = np.frombuffer(file.read(n * width), dtype).astype("<u4")
                crcs.append(zlib.crc32(values.tobytes()))
                ids.append(values)
            out = [batch.column("key"), batch.column("rank"), batch.column("shard"), batch.column("first"), batch.column("n_ids"), pa.array(crcs, pa.int64())]
            names = ["key", "rank", "shard", "first", "n_ids", "ids_crc32"]
            if with_ids:
                offsets = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)
        if file is not None:
            file.close()

    return read


@dataclass
class TokenStore:
    """A written store: where it is, its width and the ids before each shard."""

    spark: SparkSession
    folder: str
    width: int
    n_buckets: int
    key_type: str
    before: dict[int, int]
    directory: DataFrame

    def _hashed(self, keys: DataFrame) -> DataFrame:
        hash1 = F.xxhash64("key", "rank")
        return keys.select(
            "key", "rank", hash1.alias("hash1"), F.xxhash64("key", "rank", F.lit(1)).alias("hash2"),
            F.pmod(hash1, F.lit(self.n_buckets)).alias("bucket"),
        )

    def find(self, keys: DataFrame) -> DataFrame:
        """Index lookups for ``(key, rank)``: adds shard (-1: not in the store), first, n_ids."""
        dealt = self._hashed(keys).repartition("bucket").sortWithinPartitions("bucket")
        schema = f"key {self.key_type}, rank bigint, shard int, first bigint, n_ids bigint"
        return dealt.mapInArrow(_index_reader(self.folder), schema)

    def read(self, keys: DataFrame, with_ids: bool = False) -> DataFrame:
        """Documents behind keys: ``key, rank, start, n_ids, ids_crc32`` and ``ids`` if asked.

        ``start`` counts the ids of all documents before it. Keys that the store does
        not hold give no row.
        """
        found = self.find(keys).where("shard >= 0").repartition("shard").sortWithinPartitions("shard", "first")
        schema = f"key {self.key_type}, rank bigint, shard int, first bigint, n_ids bigint, ids_crc32 bigint"
        schema += ", ids array<int>" if with_ids else ""
        rows = found.mapInArrow(_payload_reader(self.folder, self.width, with_ids), schema)
        # One row per shard; a shard is one task's work.
        before = self.spark.createDataFrame(sorted(self.before.items()) or [(0, 0)], "shard int, __before bigint")
        return rows.join(before, "shard").withColumn("start", F.col("__before") + F.col("first")).drop("__before", "shard", "first")

    def lookup(self, key: int, rank: int = 0) -> np.ndarray | None:
        """Ids of one document of an integer key, read on the driver; None if unknown."""
        def chained(*values):
            seed = 42
            for kind, value in values:
                seed = xxhash.xxh64_intdigest(struct.pack(kind, value), seed)
            return seed

        first = chained(("<q", key), ("<q", rank))
        second = np.array([chained(("<q", key), ("<q", rank), ("<i", 1))], np.uint64)
        signed = first - (1 << 64) if first >= 1 << 63 else first
        fs, root = _open(self.folder)
        perfect, cols = _load_index(fs, root, signed % self.n_buckets)
        if perfect is None:
            return None
        at = int(perfect.numbers(np.array([first], np.uint64), second)[0])
        if at < 0 or cols["print"][at] != second.astype(np.uint32)[0]:
            return None
        with fs.open_input_file(_shard_name(root, int(cols["shard"][at]))) as f:
            f.seek(int(cols["first"][at]) * self.width)
            return np.frombuffer(f.read(int(cols["n_ids"][at]) * self.width), f"<u{self.width}").astype(np.uint32)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI; a plain path is one of Spark's default file system.

    On a cluster whose default is each machine's own disk a plain path would send every
    shard to another disk, which is an error; a disk that all share is named ``file:///...``.
    """
    plain = re.match("[A-Za-z][A-Za-z0-9+.-]*:", folder) is None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if plain and whole.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{folder} is a folder of each machine; name a shared one by its URI")
    return re.sub(r"^file:/+", "file:///", whole)


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text"
) -> TokenStore:
    """Encode every whole text and write shards and index to ``folder``.

    ``folder`` is a URI that every executor reaches, or a path of Spark's default file system. Null and empty texts have
    only the end id, if any. Rows that repeat a key are told apart by their rank among
    its rows, in order of text; a null key sorts first and is found like any other. An
    empty table gives a store without shards. Extra columns are not read.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    key_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(F.col(text_col)).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    schema = f"key {key_type}, rank bigint, shard int, first bigint, n_ids bigint"
    directory = settle(ordered.mapInArrow(_shard_writer(folder, tokenizer, end_id), schema))
    totals = directory.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.count("*").alias("docs")).orderBy("shard").collect()
    before, at = {}, 0
    for row in totals:
        before[row["shard"]], at = at, at + row["n"]
    n_buckets = max(1, -(-sum(r["docs"] for r in totals) // KEYS_PER_BUCKET))
    store = TokenStore(spark, folder, encoder_for(tokenizer).dtype.itemsize, n_buckets, key_type, before, directory)
    entries = directory.withColumns(
        {"hash1": F.xxhash64("key", "rank"), "hash2": F.xxhash64("key", "rank", F.lit(1))}
    ).withColumn("bucket", F.pmod("hash1", F.lit(n_buckets)))
    built = entries.select("bucket", "hash1", "hash2", "shard", "first", "n_ids").repartition(n_buckets, "bucket")
    settle(built.mapInArrow(_index_writer(folder), "bucket bigint, n_keys bigint"))
    return store
