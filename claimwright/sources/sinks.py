"""Table, variant, cache, log and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from claimwright import schemas
from claimwright.operators.runs import latest_per_step
from claimwright.sources import versions


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> versions.Version:
    """Replace a stage table by a new version. CSV holds arrays as JSON text."""
    if fmt != "csv":
        return versions.replace(df, path, fmt)
    arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    df = df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return versions.replace(df, path, fmt, header=True, escape='"', **spaces)


def write_variants(df: DataFrame, path: str) -> versions.Version:
    """All lengths and splits in one write and one version, one folder per (L, split).

    Rows are gathered by folder so that a task does not open a file in each of
    them; the rebalance lets adaptive execution cut a folder of any size into
    tasks of the advisory size, and join small ones.
    """
    folders = df.hint("rebalance", F.col("L"), F.col("split"))
    return versions.replace(folders, path, partition_by=("L", "split"))


def write_splits(df: DataFrame, path: str) -> versions.Version:
    return versions.replace(df.hint("rebalance", F.col("split")), path, partition_by=("split",))


def _fingerprint_columns(df: DataFrame, key: str, width: str | None) -> list[Column]:
    others = [c for c in df.columns if c != key]
    plain = [F.to_json(F.struct(c)) if "map" in t or "variant" in t else F.col(c) for c, t in df.dtypes if c in others]
    hashed = F.sum(F.xxhash64(key, *plain).cast("decimal(20,0)"))
    widest = F.max(F.size(width)) if width else F.max(F.lit(0))
    return [
        F.count("*").alias("rows"),
        F.coalesce(hashed, F.lit(0)).cast("string").alias("keys"),
        F.coalesce(widest, F.lit(0)).cast("int").alias("width"),
    ]


def fingerprint(df: DataFrame, key: str, width: str | None = None) -> DataFrame:
    """One row: number of rows, order-free hash of keys and values, widest array."""
    return df.agg(*_fingerprint_columns(df, key, width))


def materialize(
    df: DataFrame, path: str, key: str = "row_id", width: str | None = None, overwrite: bool = False, stamp: str | None = None
) -> tuple[DataFrame, bool]:
    """Keep ``df`` as a table, rebuilt only where it has changed; returns the table and whether it is new.

    ``df`` is computed once: its fingerprint (row count, keys with their values, width) is
    observed while it is written. A write that turns out equal to the current version is
    dropped, and that version stays. ``stamp`` names what ``df`` is made from, such as the
    number of the version it reads and its parameters: while the stamp is that of the
    current version, ``df`` is not computed at all.
    """
    spark = df.sparkSession
    known = None if overwrite else versions.current(spark, path)
    if known and stamp is not None and known.note.get("stamp") == stamp:
        return versions.read(spark, path), False
    seen = Observation()
    watched = df.observe(seen, *_fingerprint_columns(df, key, width))
    data = versions.stage(path, watched.write.parquet)
    note = {"fingerprint": dict(seen.get), "stamp": stamp}
    if known and known.note.get("fingerprint") == note["fingerprint"]:
        versions.discard(spark, path, data)
        if stamp is not None:
            versions.commit(spark, path, known.data, known.format, note)
        return versions.read(spark, path), False
    versions.commit(spark, path, data, "parquet", note)
    return versions.read(spark, path), True


def write_key_values(df: DataFrame, path: str) -> None:
    """A small key/value table, one ``key<TAB>value`` line per entry."""
    df.select(F.concat_ws("\t", *df.columns)).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """A vocabulary as JSON lines, written by all tasks."""
    vocab.write.mode("overwrite").json(path)


def append_log(spark: SparkSession, path: str, step: str, metrics: DataFrame | dict) -> None:
    """Append one entry: a dict, or the first row of a summary table."""
    if isinstance(metrics, DataFrame):
        names = metrics.columns
        pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
        entry = metrics.limit(1).select(F.create_map(*pairs).alias("metrics"))
    else:
        entry = spark.createDataFrame(
            [({str(k): str(v) for k, v in metrics.items()},)], "metrics map<string,string>"
        )
    entry.select(
        F.lit(step).alias("step"),
        F.current_timestamp().alias("ts"),
        F.version().alias("runtime"),
        "metrics",
    ).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Latest entry per step; lines that are not valid JSON are left out."""
    log = spark.read.schema(schemas.RUN_LOG).option("mode", "DROPMALFORMED").json(path)
    return latest_per_step(log)


def append_epochs(df: DataFrame, path: str) -> None:
    """Add rows to the per-epoch metrics table."""
    schemas.check_schema(df, schemas.EPOCH)
    df.select(*schemas.EPOCH.names).write.mode("append").parquet(path)


def append_result(df: DataFrame, path: str) -> None:
    """Add a run record as JSON."""
    df.select(*[c for c in schemas.RESULT.names if c in df.columns]).write.mode("append").json(path)


def write_cards(df: DataFrame, text: str, path: str, order: str) -> None:
    """Text cards in order, within and across the files."""
    df.orderBy(order).select(text).write.mode("overwrite").text(path)
