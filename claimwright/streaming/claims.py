"""The claim stream: clean, tag, drop repeats, and report tag rates by tumbling windows.

Cleaning and tagging are the row-local functions of the batch jobs. A text counts once in
each window, so the rates do not depend on which of its copies came first, nor on how the
stream is cut into batches: over rows that are not too late they equal ``window_rates``,
the batch form. State is one hash for each text of the open windows and one row of sums for
each of these windows; both go when the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from claimwright.functions import concepts as C, text as T
from claimwright.operators import summaries
from claimwright.session import scratch_path

EVENT_TIME = "event_time"


def read_claims(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """Files as they arrive in a folder. The schema is given; nothing is inferred."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def tagged(claims: DataFrame, text: str = "statement", lexicon: C.Lexicon | None = None) -> DataFrame:
    """``event_time``, a hash of the cleaned text and its tag codes; rows without text or time are dropped."""
    cleaned = claims.where(F.col(text).isNotNull() & F.col(EVENT_TIME).isNotNull()).select(
        EVENT_TIME, T.clean_basic(F.col(text)).alias("_clean")
    )
    return cleaned.select(EVENT_TIME, F.md5("_clean").alias("text_key"), C.concept_codes(T.tokenize(F.col("_clean")), lexicon).alias("codes"))


def counted(rows: DataFrame) -> DataFrame:
    """The counters of each row in place of its codes, which are as long as its text."""
    return rows.select(*[c for c in rows.columns if c != "codes"], *[c.alias(name) for name, c in C.concept_counters(F.col("codes")).items()])


def _seconds(spark: SparkSession, span: str) -> int:
    """The length of a span such as ``90 minutes``; months have none."""
    january, february = F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(31 * 86400))
    long = spark.range(1).select(*(F.unix_seconds(t + F.expr(f"interval {span}")) - F.unix_seconds(t) for t in (january, february))).first()
    if long[0] != long[1]:
        raise ValueError(f"{span!r} has no fixed length")
    return long[0]


def once_per_window(rows: DataFrame, window: str, delay: str) -> DataFrame:
    """One row for each text in each window: ``window, text_key`` and what else the rows hold.

    A repeat is recognised as long as its window is open. That needs the delay to be no
    shorter than the window: a text's hash is kept for the delay after its own time.
    """
    width = _seconds(rows.sparkSession, window)
    if _seconds(rows.sparkSession, delay) < width:
        raise ValueError(f"a delay of {delay} forgets texts before a window of {window} ends")
    # A plain number, since a stream may have one event-time column only.
    number = F.floor(F.unix_micros(EVENT_TIME) / (width * 1_000_000))
    once = rows.withWatermark(EVENT_TIME, delay).withColumn("_number", number).dropDuplicatesWithinWatermark(["_number", "text_key"])
    return once.select(F.window(EVENT_TIME, window).alias("window"), *[c for c in rows.columns if c != EVENT_TIME])


def _named(rates: DataFrame) -> DataFrame:
    return rates.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in rates.columns if c != "window"])


def stream_rates(claims: DataFrame, window: str, delay: str, text: str = "statement", lexicon: C.Lexicon | None = None) -> DataFrame:
    """Tag counts and shares of each window of a stream, given out once the window is closed.

    A window is closed when the watermark, the latest time seen less ``delay``, reaches its
    end. Rows older than the watermark are late and left out.
    """
    once = once_per_window(counted(tagged(claims, text, lexicon)), window, delay)
    return _named(summaries.concept_totals(once, by=["window"]))


def window_rates(claims: DataFrame, window: str, delay: str, text: str = "statement", lexicon: C.Lexicon | None = None) -> DataFrame:
    """The same of a table: windows that a stream over its rows, none of them late, would have closed."""
    rows = counted(tagged(claims, text, lexicon)).withColumn("window", F.window(EVENT_TIME, window))
    names = [c for c in rows.columns if c.endswith("_tokens")]
    once = rows.groupBy("window", "text_key").agg(*[F.first(c).alias(c) for c in names])
    rates = _named(summaries.concept_totals(once, by=["window"]))
    latest = claims.where(F.col(text).isNotNull()).agg(F.max(EVENT_TIME).alias("_latest"))
    closed: Column = F.col("window_end") <= F.col("_latest") - F.expr(f"interval {delay}")
    return rates.join(F.broadcast(latest), closed).drop("_latest")


def run_available(rates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, append closed windows to ``out``, and end.

    The state and the place in the input are kept in ``checkpoint``, in a shared folder; a
    run that dies is repeated from there, and ``out`` gets each window once.
    """
    query = rates.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def replay(parts: list[DataFrame], window: str, delay: str, text: str = "statement", lexicon: C.Lexicon | None = None) -> DataFrame:
    """Rates over tables that arrive one after the other, each met by a run that resumes the last."""
    spark = parts[0].sparkSession
    folder = scratch_path(spark, "claim-stream")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        rates = stream_rates(read_claims(spark, f"{folder}/in", part.schema), window, delay, text, lexicon)
        run_available(rates, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(rates.schema).parquet(f"{folder}/out")
