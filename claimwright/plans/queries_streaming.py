"""The claim stream over the test tables."""

from pyspark.sql import functions as F

from claimwright.plans import bindings as B
from claimwright.plans.registry import query
from claimwright.streaming import claims as stream

WINDOW, DELAY = "24 hours", "48 hours"
#: The day of document 0. A watermark starts at day 0, before which all rows are late.
FIRST_DAY = 10_000

_RATES_SQL = f"""base AS (
  SELECT doc_id, doc_id // 24 AS day, {B.sql_clean_basic('text')} AS clean FROM documents WHERE text IS NOT NULL),
docs AS (
  SELECT min(doc_id) AS row_id, day, {B.sql_tokens('clean')} AS tokens FROM base GROUP BY day, clean),
{B.sql_tagged('docs')},
per AS (
  SELECT row_id, count(*) AS n, count(*) FILTER (cue = 'EMOTION') AS em,
    count(*) FILTER (cue = 'MODALITY') AS mc, count(*) FILTER (reach = 'MODALITY') AS ms,
    count(*) FILTER (cue = 'NEGATION') AS nc, count(*) FILTER (reach = 'NEGATION') AS ns FROM scoped GROUP BY row_id),
s AS (
  SELECT day, count(*) AS total_samples, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(em), 0) AS BIGINT) AS emotion_tokens,
    CAST(coalesce(sum(mc), 0) AS BIGINT) AS modality_cue_tokens, CAST(coalesce(sum(ms), 0) AS BIGINT) AS modality_scope_tokens,
    CAST(coalesce(sum(nc), 0) AS BIGINT) AS negation_cue_tokens, CAST(coalesce(sum(ns), 0) AS BIGINT) AS negation_scope_tokens
  FROM docs LEFT JOIN per USING (row_id) GROUP BY day)"""
_STREAM_SQL = f"""WITH {_RATES_SQL}
SELECT *, round(emotion_tokens / greatest(total_tokens, 1), 4) AS emotion_ratio,
  round((modality_cue_tokens + modality_scope_tokens) / greatest(total_tokens, 1), 4) AS modality_ratio,
  round((negation_cue_tokens + negation_scope_tokens) / greatest(total_tokens, 1), 4) AS negation_ratio
FROM s WHERE day + 1 <= (SELECT max(doc_id) FROM base) / 24 - 2"""


def _events(spark, sf):
    """One document an hour, in the order of its id."""
    docs = B.table(spark, sf, "documents")
    return docs.select(F.timestamp_seconds(F.col("doc_id") * 3600 + FIRST_DAY * 86400).alias("event_time"), F.col("text").alias("statement"), "doc_id")


def _by_day(rates):
    day = F.floor(F.unix_seconds("window_start") / 86400).cast("long") - FIRST_DAY
    return rates.select(day.alias("day"), *[c for c in rates.columns if not c.startswith("window")])


@query("claim_stream", _STREAM_SQL)
def claim_stream(spark, sf):
    # Three arrivals; each brings the next third of the table, a tenth of the third before it
    # once more, and these copies again under the times of their own window.
    events = _events(spark, sf)
    last = events.agg(F.max("doc_id")).first()[0] or 0
    third = last // 3 + 1

    def part(k):  # a range of ids, so that files without any are not read
        return (F.col("doc_id") >= k * third) & (F.col("doc_id") < (k + 1) * third)

    arrivals = []
    for k in range(3):
        again = events.where(part(k - 1) & (F.col("doc_id") % 10 == 0))
        moved = again.withColumn("event_time", F.date_trunc("DAY", "event_time"))
        arrivals.append(events.where(part(k)).unionByName(again).unionByName(moved).drop("doc_id"))
    return _by_day(stream.replay(arrivals, WINDOW, DELAY, lexicon=B.TEST_LEXICON))


@query("claim_window_rates", _STREAM_SQL)
def claim_window_rates(spark, sf):
    return _by_day(stream.window_rates(_events(spark, sf).drop("doc_id"), WINDOW, DELAY, lexicon=B.TEST_LEXICON))
