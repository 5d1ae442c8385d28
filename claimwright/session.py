"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only on one machine, as in tests,
    a temporary folder is made for the session where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback_dirs:
            _fallback_dirs[app] = tempfile.mkdtemp(prefix="claimwright-")
        named = _fallback_dirs[app]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/claimwright/{name}-{uuid.uuid4().hex[:12]}"


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for files that are not Spark's own.

    It is the URI that Spark makes of the path, so that such files lie where settled tables do.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started inside send Python ``most`` rows at a time, or fewer if the session says so."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


#: Codec of stored tables of texts and token lists, which takes a third less space than the default.
TEXT_CODEC = "zstd"


def settle(df: DataFrame, batch_rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and keeps a
    table that several branches use from being computed in each of them. Python steps on
    whole token lists name their ``batch_rows``: a batch lies in the JVM and in a worker, for each
    step and core, and 10,000 rows of lists take hundreds of MB there. Tables of whole texts
    name a ``codec``.
    """
    path = scratch_path(df.sparkSession, "settled")
    with arrow_rows(df.sparkSession, batch_rows) if batch_rows else nullcontext():
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` stays within a row bound; counts no further than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after its row count is known to be within the bound.

    Beyond the bound the table is returned as it is: the join then shuffles, and
    adaptive execution splits hot keys.
    """
    fixed = settle(df)
    return F.broadcast(fixed) if has_at_most(fixed, max_rows) else fixed


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan with fewer tasks than cores out over the cores, by key.

    A small file with one row group is one task, and text work is heavy per row.
    A scan that has enough tasks, as any large one does, is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
