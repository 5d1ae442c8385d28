"""Records of delimited files whose quoted fields may span lines, read by many tasks.

A file is cut into blocks at line ends, as Spark cuts any text file, and whether a block
starts inside a quoted field depends on all that stands before it. Each line therefore
becomes a map of two states, outside or inside a quoted field, and a block the composition
of its lines' maps. These are chained over the blocks of a file, one row each, which gives
every block its true start state and the number of records before it. A second pass cuts
each block into records from its first true record start; pieces of the few records that
cross a block's end are put together by their number.

A quote opens a field only at the field's start; inside a quoted field each quote toggles, so a
doubled quote stays inside. Lines end with a line feed; a carriage return before it is kept
inside quotes and dropped at a record's end. Empty records are skipped.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from claimwright.session import broadcast_if_small, has_at_most, settle

MAX_BLOCKS = 500_000
#: Maps of (outside, inside), as ``after outside + 2 * after inside`` with 1 for inside.
CLOSES, SWAPS, KEEPS, OPENS = 0, 1, 2, 3
WHOLE, HEAD, TAIL, HEADER = 0, 1, 2, 3
_BLOCK = "path string, block long, starts array<long>, ends int, header string"


def line_map(line: Column, sep: str) -> Column:
    """What a line does to the two states."""
    fields = F.split(line, re.escape(sep), -1)
    odd = lambda field: (F.length(field) - F.length(F.replace(field, F.lit('"')))) % 2 == 1

    def step(state: Column, field: Column) -> Column:
        outside = field.startswith('"') & odd(field)
        return F.struct(
            F.when(state["o"], ~odd(field)).otherwise(outside).alias("o"),
            F.when(state["i"], ~odd(field)).otherwise(outside).alias("i"),
        )

    folded = F.aggregate(fields, F.struct(F.lit(False).alias("o"), F.lit(True).alias("i")), step, lambda s: s["o"].cast("int") + 2 * s["i"].cast("int"))
    return F.when(line.contains('"'), folded).otherwise(KEEPS)


def lines(spark: SparkSession, paths: list[str] | str, sep: str) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(paths)
    return scan.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        line_map(F.col("value"), sep).cast("byte").alias("map"),
    )


def states(maps: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line starts inside a quoted field, and, last, whether the line after them does."""
    swaps = np.concatenate([[0], np.cumsum(maps == SWAPS)])
    fixed = (maps == CLOSES) | (maps == OPENS)
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, len(maps) + 1), 0)]))
    value = np.concatenate([[start], maps == OPENS])
    return value[last] ^ ((swaps - swaps[last]) % 2 == 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Slices of batches that belong to one block; a block's lines come in order."""
    for batch in batches:
        path, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        cuts = [0, *(k for k in range(1, len(path)) if block[k] != block[k - 1] or path[k] != path[k - 1]), len(path)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield path[a], int(block[a]), batch.slice(a, b - a)


def _filled(values: pa.Array) -> np.ndarray:
    lengths = pa.compute.binary_length(values).to_numpy()
    only_return = pa.compute.equal(values, "\r").to_numpy(zero_copy_only=False)
    return (lengths > 0) & ~only_return


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: records that start in it and its end, for both start states, and the file's first record line."""
    path, block, ends, starts, header = None, 0, [False, True], [0, 0], None

    def row():
        return pa.RecordBatch.from_pylist(
            [{"path": path, "block": block, "starts": starts, "ends": int(ends[0]) + 2 * int(ends[1]), "header": header}],
            pa.schema([("path", pa.string()), ("block", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.int32()), ("header", pa.string())]),
        )

    for own, at, batch in _runs(batches):
        if (own, at) != (path, block):
            if path is not None:
                yield row()
            path, block, ends, starts, header = own, at, [False, True], [0, 0], None
        maps, filled = batch.column(3).to_numpy(), _filled(batch.column(2))
        for k in (0, 1):
            inside = states(maps, ends[k])
            begins = ~inside[:-1] & (filled | inside[1:])
            if k == 0 and block == 0 and header is None and begins.any():
                header = batch.column(2)[int(begins.argmax())].as_py()
            starts[k] += int(begins.sum())
            ends[k] = bool(inside[-1])
    if path is not None:
        yield row()


def survey(scan: DataFrame) -> DataFrame:
    """One stored row for each block: ``path, block, starts, ends, header``, the header of its file."""
    found = settle(scan.mapInArrow(_survey, _BLOCK))
    first = F.first("header", ignorenulls=True).over(Window.partitionBy("path"))
    return found.withColumn("header", F.regexp_replace(first, "^\ufeff|\r$", ""))


def header_names(header: str | None, sep: str) -> list[str]:
    return next(csv.reader([header], delimiter=sep)) if header else []


def numbered(blocks: DataFrame, order: Column, header: bool, keep: Column | None = None) -> DataFrame:
    """``path, block, header, inside, records, before``: each block's start state and first record's number.

    ``order`` ranks files, by path where it is equal. A header is no record. Files that
    ``keep`` turns down have no numbers: ``before`` is -1.
    """
    own = Window.partitionBy("path").orderBy("block")
    fixed = F.when(F.col("ends") == OPENS, 1).when(F.col("ends") == CLOSES, 0)
    chained = blocks.withColumn("_swaps", F.sum((F.col("ends") == SWAPS).cast("int")).over(own))
    chained = chained.withColumn("_fixed", F.struct(fixed.alias("v"), F.col("_swaps").alias("s")))
    chained = chained.withColumn("_last", F.last(F.when(fixed.isNotNull(), F.col("_fixed")), ignorenulls=True).over(own))
    after = (F.coalesce(F.col("_last.v"), F.lit(0)) + F.col("_swaps") - F.coalesce(F.col("_last.s"), F.lit(0))) % 2
    chained = chained.withColumn("inside", F.coalesce(F.lag(after).over(own), F.lit(0)) == 1)
    count = F.get("starts", F.col("inside").cast("int"))
    if header:
        count = count - F.when((F.col("block") == 0) & (count > 0), 1).otherwise(0)
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    # One row per file block of some 100 MB, so this window stays small.
    earlier = Window.orderBy(order, "path", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(kept, count).otherwise(0)).over(earlier), F.lit(0))
    return chained.select("path", "block", "header", "inside", count.alias("records"), F.when(kept, before).otherwise(-1).alias("before"))


_PIECE = pa.schema([("path", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("kind", pa.int8()), ("record", pa.string())])


class _Open:
    """The record that the lines read last belong to; a tail ends a record of an earlier block."""

    def __init__(self, number: int, kind: int, lines: list[str]):
        self.number, self.kind, self.lines = number, kind, lines

    def piece(self, path: str, block: int, ended: bool) -> dict:
        kind = self.kind
        if not ended and kind != TAIL:
            if kind == HEADER:
                raise ValueError(f"{path}: the header does not end")
            kind = HEAD
        return {"path": path, "number": self.number, "block": block, "kind": kind, "record": "\n".join(self.lines)}


def _cut(header: bool):
    """Records of the blocks, each with its number; those that cross a border in pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, block, inside, number, open_ = None, 0, False, 0, None
        for own, at, batch in _runs(batches):
            ready = []
            if (own, at) != (path, block):
                if open_:
                    ready.append(open_.piece(path, block, not inside))
                path, block = own, at
                if batch.column(5)[0].as_py() is None:
                    raise RuntimeError(f"{path} was cut into other blocks than before; read it again")
                inside, number = bool(batch.column(4)[0].as_py()), batch.column(5)[0].as_py()
                open_ = _Open(number - 1, TAIL, []) if inside else None
                fresh = header and block == 0
            values = batch.column(2)
            state = states(batch.column(3).to_numpy(), inside)
            blank = ~state[:-1] & ~_filled(values) & ~state[1:]
            begins = np.flatnonzero(~state[:-1] & ~blank)
            ends = np.append(begins[1:], len(values))
            texts = lambda a, b: [v for v, skip in zip(values.slice(a, b - a).to_pylist(), blank[a:b]) if not skip]
            if open_:
                open_.lines += texts(0, int(begins[0]) if len(begins) else len(values))
            if len(begins):
                if open_:
                    ready.append(open_.piece(path, block, True))
                numbers = number - fresh + np.arange(len(begins))
                kinds = np.where(np.arange(len(begins)) < fresh, HEADER, WHOLE).astype(np.int8)
                alone = np.flatnonzero(ends[:-1] == begins[:-1] + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(alone), pa.string()),
                        pa.array(numbers[alone]),
                        pa.array(np.full(len(alone), block)),
                        pa.array(kinds[alone]),
                        values.take(pa.array(begins[alone])),
                    ],
                    schema=_PIECE,
                )
                for k in np.flatnonzero(ends[:-1] != begins[:-1] + 1):
                    ready.append(_Open(int(numbers[k]), int(kinds[k]), texts(int(begins[k]), int(ends[k]))).piece(path, block, True))
                open_ = _Open(int(numbers[-1]), int(kinds[-1]), texts(int(begins[-1]), len(values)))
                number, fresh = int(numbers[-1]) + 1, 0
            inside = bool(state[-1])
            yield pa.RecordBatch.from_pylist(ready, _PIECE)
        if open_:
            yield pa.RecordBatch.from_pylist([open_.piece(path, block, not inside)], _PIECE)

    return cut


def records_of(scan: DataFrame, blocks: DataFrame, header: bool) -> DataFrame:
    """``row_id, path, header, record`` of the lines of ``scan``, whose blocks ``blocks`` numbers."""
    blocks = settle(blocks)
    if has_at_most(blocks, MAX_BLOCKS):
        placed = scan.join(F.broadcast(blocks), ["path", "block"], "left")
    else:
        # A shuffled join loses the order of lines.
        marked = scan.withColumn("_at", F.monotonically_increasing_id())
        placed = marked.join(blocks, ["path", "block"], "left").sortWithinPartitions("path", "block", "_at")
    placed = placed.where("before is null or before >= 0").select("path", "block", "value", "map", "inside", "before")
    pieces = placed.mapInArrow(_cut(header), "path string, number long, block long, kind byte, record string")
    whole = pieces.where(F.col("kind") == WHOLE).select("number", "path", "record")
    parts = pieces.where(F.col("kind").isin(HEAD, TAIL)).groupBy("number", "path").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"))
    joined = parts.select("number", "path", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    records = whole.unionAll(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    if not header:
        return records.select(F.col("number").alias("row_id"), "path", F.lit(None).cast("string").alias("header"), "record")
    named = broadcast_if_small(blocks.select("path", "header").distinct(), MAX_BLOCKS)
    return records.join(named, "path").select(F.col("number").alias("row_id"), "path", "header", "record")


def read_records(spark: SparkSession, paths: list[str] | str, sep: str, order: Column | None = None, header: bool = False) -> DataFrame:
    """``row_id, path, header, record``: records as texts, numbered from 0 in file order and line order.

    ``order`` is an expression over ``path`` by which files are numbered, by default the path.
    With ``header`` the first record of each file is given to all of the file's records instead
    of being one; it has to fit on one line.
    """
    scan = lines(spark, paths, sep)
    return records_of(scan, numbered(survey(scan), F.col("path") if order is None else order, header), header)


def fields(record: Column, schema: StructType, sep: str) -> Column:
    """A record's fields as a struct; malformed values are null, missing ones too."""
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return F.from_csv(record, columns, {"sep": sep, "escape": '"', "multiLine": "true"})
