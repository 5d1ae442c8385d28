"""File sources. Every scan has an explicit schema; nothing is inferred."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from claimwright import schemas
from claimwright.functions import labels as L
from claimwright.session import broadcast_if_small, settle
from claimwright.sources import records, versions

MAX_BLOCKS = 500_000
# Parts of a snapshot file name
SNAPSHOT_SUFFIX = "COVID-19.csv"
SNAPSHOT_TEXT = "title"


def with_row_id(df: DataFrame, file_order, columns: list[str]) -> DataFrame:
    """Number the rows of a file scan from 0, in file order and line order.

    Within one block of a file the generated ids rise line by line, so the
    position in the block is the distance to the block's smallest id. Adding the
    rows of all earlier blocks gives a dense number that does not depend on how
    the blocks are packed into tasks, without a shuffle. The scan is stored
    first: how a file is cut into blocks can change between two reads when
    executors come and go. ``df`` must be a scan with ``_metadata``, not yet
    filtered.
    """
    rows = settle(
        df.select(
            *columns,
            file_order.alias("_file"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    blocks = rows.groupBy("_file", "_path", "_block").agg(
        F.min("_at").alias("_from"), F.count("*").alias("_n")
    )
    # One row per file block of some 100 MB, so this window stays small.
    earlier = Window.orderBy("_file", "_path", "_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = broadcast_if_small(blocks.drop("_n", "_file"), MAX_BLOCKS)
    return rows.join(blocks, ["_path", "_block"]).select(
        (F.col("_before") + F.col("_at") - F.col("_from")).alias("row_id"), *columns
    )


def read_political_tsv(
    spark: SparkSession, paths: list[str], quoted: bool = True, multi_line: bool = True
) -> DataFrame:
    """The header-less claim files, in the given order, with ``row_id``.

    ``quoted`` honours double quotes with doubled-quote escapes. By default a quoted field
    may span lines; files are cut into blocks all the same (:mod:`claimwright.sources.records`).
    ``multi_line=False`` saves the pass that finds out how blocks start; it fails on rows of
    another width, as a line break inside quotes would leave.
    """
    # Whole paths, since two folders may hold files of the same name. One entry per input.
    place = F.lit(len(paths))
    spanning = quoted and multi_line
    found = F.concat(F.regexp_replace("path" if spanning else "_metadata.file_path", r"^file:/+", "/"), F.lit("/"))
    for i, path in reversed(list(enumerate(paths))):
        own = re.sub(r"^file:/+", "/", path.rstrip("/")) + "/"
        place = F.when(F.url_decode(F.regexp_replace(found, r"\+", "%2B")).startswith(own), i).otherwise(place)
    if spanning:
        rows = records.read_records(spark, paths, "\t", place)
        columns = records.fields(F.col("record"), schemas.RAW_POLITICAL, "\t")
        numbered = rows.select("row_id", columns.alias("f")).select("row_id", *[F.col(f"f.{c}") for c in schemas.POLITICAL_COLUMNS])
    else:
        reader = (
            spark.read.schema(schemas.RAW_POLITICAL)
            .option("sep", "\t")
            .option("quote", '"' if quoted else "\0")
            .option("escape", '"' if quoted else "\0")
            .option("mode", "FAILFAST" if quoted else "PERMISSIVE")
        )
        numbered = with_row_id(reader.csv(paths), place, schemas.POLITICAL_COLUMNS)
    texts = ["label", "statement", "subject", "speaker", "party", "context"]
    return numbered.withColumns({c: L.null_if_marker(F.col(c)) for c in texts})


def read_header_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stage table stored as CSV; each file's header is checked against the schema."""
    scan = records.lines(spark, versions.location(spark, path), ",")
    blocks = records.survey(scan)
    for row in blocks.select("header").where("header is not null").distinct().collect():
        names = records.header_names(row["header"], ",")
        if [n.lower() for n in names] != [n.lower() for n in schema.names]:
            raise ValueError(f"{path}: the header {names} is not {schema.names}")
    rows = records.records_of(scan, records.numbered(blocks, F.col("path"), True), True)
    return rows.select(records.fields(F.col("record"), schema, ",").alias("f")).select("f.*")


def classify_snapshot(name):
    """``(subset, label)`` of a snapshot file name; null unless exactly one of each is named."""
    claim, news = name.contains("Claim"), name.contains("News")
    fake, real = name.contains("Fake"), name.contains("Real")
    valid = (claim != news) & (fake != real)
    return (
        F.when(valid, F.when(claim, "claim").otherwise("news")),
        F.when(valid, F.when(fake, "fake").otherwise("real")),
    )


def _snapshot_paths(spark: SparkSession, folder: str) -> list[str]:
    """Snapshot files of a folder by name; one may itself be a folder of part files."""
    pattern = f"{folder.rstrip('/')}/*{SNAPSHOT_SUFFIX}"
    try:
        found = spark.read.text(pattern).inputFiles()
    except AnalysisException as e:
        raise FileNotFoundError(f"no {pattern}") from e
    return sorted({unquote(f[: f.index(SNAPSHOT_SUFFIX) + len(SNAPSHOT_SUFFIX)]) for f in found})


def _snapshots(spark: SparkSession, folder: str, text: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Lines of all snapshot files, their numbered blocks, and the place of ``text`` in each header that has it.

    One pass over the files; the driver sees their distinct headers only.
    """
    scan = records.lines(spark, _snapshot_paths(spark, folder), ",")
    blocks = records.survey(scan).withColumn("source_file", _source_file(F.col("path")))
    headers = [r["header"] for r in blocks.select("header").where("header is not null").distinct().collect()]
    names = {h: records.header_names(h, ",") for h in headers}
    places = {h: n.index(text) for h, n in names.items() if text in n}
    return scan, records.numbered(blocks, F.col("source_file"), True, F.col("header").isin(list(places))), places


def _source_file(path):
    return F.regexp_extract(path, rf"([^/]*{SNAPSHOT_SUFFIX.replace('.', '[.]')})", 1)


def snapshot_report(spark: SparkSession, folder: str, text: str = SNAPSHOT_TEXT) -> DataFrame:
    """One row per snapshot file: ``source_file, subset, label, rows, skipped``.

    ``skipped`` says why a file is left out, and is null for files that are read. Only the
    table of file blocks is used; no record is made.
    """
    _, blocks, _ = _snapshots(spark, folder, text)
    files = blocks.groupBy(_source_file(F.col("path")).alias("source_file")).agg(
        F.max(F.col("before") >= 0).alias("has_text"), F.sum("records").alias("rows")
    )
    subset, label = classify_snapshot(F.col("source_file"))
    why = F.when(~F.col("has_text"), f"no column {text}").when(subset.isNull(), "name does not classify")
    return files.select(
        "source_file", subset.alias("subset"), label.alias("label"),
        F.when(why.isNull(), F.col("rows")).alias("rows"), why.alias("skipped"),
    )


def read_snapshots(spark: SparkSession, folder: str, text: str = SNAPSHOT_TEXT) -> DataFrame:
    """Every snapshot file of a folder: ``row_id, statement, label, subset, source_file``.

    A file without the text column is skipped, as is one whose name does not say
    both what it holds and whether that is fake; ``snapshot_report`` lists them. A file
    that cannot be read fails the job. All files are one scan, cut into blocks of any
    size; quoted fields may span lines.
    """
    scan, blocks, places = _snapshots(spark, folder, text)
    if not places:
        raise ValueError(f"no snapshot in {folder} has a column {text!r}")
    rows = records.records_of(scan, blocks, True)
    statement = F.lit(None).cast("string")
    for header, place in places.items():
        schema = StructType()
        for k in range(place + 1):
            schema = schema.add(f"c{k}", "string")
        statement = F.when(F.col("header") == header, records.fields(F.col("record"), schema, ",")[f"c{place}"]).otherwise(statement)
    source = _source_file(F.col("path"))
    subset, label = classify_snapshot(F.col("source_file"))
    found = rows.select("row_id", statement.alias("statement"), source.alias("source_file"))
    return (
        found.withColumns({"subset": subset, "label": label})
        .withColumn("statement", L.null_if_marker(F.col("statement")))
        .filter(F.col("subset").isNotNull())
    )


def read_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns of a feature or mask table; the others are never read."""
    return spark.read.parquet(versions.location(spark, path)).select(*columns)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records: JSON objects, one or more to a file, indented or one per line.

    A record is small and so is a file of them; each file is read whole. Between two
    records stands a line break and no comma, which never occurs inside one. A malformed
    record is an error.
    """
    files = spark.read.text(pattern, wholetext=True)
    listed = F.regexp_replace(F.trim("value"), r"\}\s*[\r\n]\s*\{", "},{")
    records = F.from_json(F.concat(F.lit("["), listed, F.lit("]")), ArrayType(schemas.RESULT), {"mode": "FAILFAST"})
    return files.select(F.explode_outer(records).alias("r")).where("r is not null").select("r.*")
