"""Tables kept as versions, of which a manifest names the current one.

A table is a folder ``path`` with one data folder per version and a ``_manifest`` folder
of small numbered JSON entries. A write goes to a fresh data folder and becomes the
current version only when its entry is put in place, which is the last step and either
happens or not. A job that dies before leaves a data folder that no entry names: readers
never see it, and the version before stays as it was. Readers pick an entry once and read
its folder, so a version that is swapped in meanwhile does not mix with it.

Entries are renamed into place and never overwritten; of two writers that take the same
number one moves on to the next, so the later commit is the current one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "_manifest"
TRIES = 100


@dataclass(frozen=True)
class Version:
    """One entry: its number, its data folder's name, the format, and what the writer noted."""

    number: int
    data: str
    format: str
    note: dict = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _path(spark, f"{path}/{MANIFEST}"), _files(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _entry(path: str, number: int) -> str:
    return f"{path}/{MANIFEST}/{number:020d}.json"


def _read_entry(spark: SparkSession, path: str, number: int) -> Version:
    stream = _files(spark, path).open(_path(spark, _entry(path, number)))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(**json.loads(text))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The latest version, or the one of that number; none where nothing was committed."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    if number is not None and number not in numbers:
        raise ValueError(f"{path} has no version {number}")
    return _read_entry(spark, path, numbers[-1] if number is None else number) if numbers else None


def location(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The folder of the current version's files; ``path`` itself where it is no versioned table."""
    path = path.rstrip("/")
    found = current(spark, path, number)
    return f"{path}/{found.data}" if found else path


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of a table whose format carries its schema."""
    path = path.rstrip("/")
    found = current(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    return spark.read.format(found.format).load(f"{path}/{found.data}")


def stage(path: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a fresh data folder, which no reader sees yet; returns its name."""
    data = f"data-{uuid.uuid4().hex}"
    write(f"{path.rstrip('/')}/{data}")
    return data


def commit(spark: SparkSession, path: str, data: str, fmt: str, note: dict | None = None) -> Version:
    """Make a data folder the current version, by one rename."""
    path = path.rstrip("/")
    files, jvm = _files(spark, path), spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration()) \
        if _path(spark, path).toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(TRIES):
        version = Version((_numbers(spark, path) or [0])[-1] + 1, data, fmt, note or {})
        draft = _path(spark, f"{path}/{MANIFEST}/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(version)), "utf-8"))
        finally:
            stream.close()
        try:
            context.rename(draft, _path(spark, _entry(path, version.number)), no_options)
            return version
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
    raise RuntimeError(f"{path}: {TRIES} other writers came first")


def discard(spark: SparkSession, path: str, data: str) -> None:
    """Delete a data folder that was staged and is not to be committed."""
    path = path.rstrip("/")
    if any(_read_entry(spark, path, n).data == data for n in _numbers(spark, path)):
        raise ValueError(f"{data} is a committed version of {path}")
    _files(spark, path).delete(_path(spark, f"{path}/{data}"), True)


def replace(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), note: dict | None = None, **options) -> Version:
    """Write ``df`` as the next version of a table.

    Nothing of earlier versions is touched, so ``df`` may read the table it replaces.
    """
    data = stage(path, lambda folder: df.write.options(**options).partitionBy(*partition_by).format(fmt).save(folder))
    return commit(df.sparkSession, path, data, fmt, note)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` latest versions; returns the numbers that went.

    Entries go before their data, so no entry ever names a folder that is gone. Readers
    of an expired version fail, so ``keep`` has to cover the longest-running one. Folders of
    jobs that died are left: a writer that is still at work looks the same.
    """
    if keep < 1:
        raise ValueError("the current version is always kept")
    path = path.rstrip("/")
    files, numbers = _files(spark, path), _numbers(spark, path)
    old = [_read_entry(spark, path, n) for n in numbers[:-keep]]
    still = {_read_entry(spark, path, n).data for n in numbers[-keep:]}
    for version in old:
        files.delete(_path(spark, _entry(path, version.number)), False)
    for data in {v.data for v in old} - still:
        files.delete(_path(spark, f"{path}/{data}"), True)
    return [v.number for v in old]


def _table_name(folder: str) -> str:
    return f"claimwright_{hashlib.md5(folder.encode()).hexdigest()}"


def replace_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> Version:
    """Write ``df`` as the next version of a table that is stored by the hash of ``key``.

    One shuffle when it is written saves one in every join on the key with a table of as
    many buckets. The rows of a bucket are sorted and lie in one file.
    """
    spark = df.sparkSession

    def write(folder: str) -> None:
        dealt = df.repartition(buckets, key)
        writer = dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", folder)
        writer.saveAsTable(_table_name(folder))

    note = {"key": key, "buckets": buckets, "schema": df.schema.json()}
    return commit(spark, path, stage(path, write), "parquet", note)


def read_bucketed(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version written by ``replace_bucketed``, as a table whose buckets Spark knows.

    The session's catalog gets an entry for the version's folder if it has none yet, so a
    table that another session wrote is read the same way.
    """
    path = path.rstrip("/")
    found = current(spark, path, number)
    if found is None or "buckets" not in found.note:
        raise ValueError(f"{path} is not stored in buckets")
    folder = f"{path}/{found.data}"
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(found.note["schema"])))
        key, buckets = quoted(found.note["key"]), found.note["buckets"]
        place = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)
