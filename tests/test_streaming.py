"""The claim stream against its batch form: batches, repeats, late rows and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimwright.streaming import claims as S

SCHEMA = "event_time timestamp, statement string"
START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(None if m is None else START + dt.timedelta(minutes=m), t) for m, t in rows], SCHEMA)


def rows_of(rates):
    return sorted(tuple(r) for r in rates.collect())


def texts(n, seed=3):
    rng = random.Random(seed)
    words = "it may not never be true , could say the fear hope sad no big car".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_stream_equals_batch_however_it_is_cut(spark):
    some = texts(40)
    rng = random.Random(5)
    rows = sorted((rng.randrange(0, 600), rng.choice(some)) for _ in range(200))
    want = rows_of(S.window_rates(frame(spark, rows), "1 hour", "90 minutes"))
    assert len(want) == 8  # the latest row is near minute 600, so windows up to minute 480 are closed
    for cuts in ([0, 200], [0, 50, 51, 120, 200]):
        parts = [frame(spark, rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert rows_of(S.replay(parts, "1 hour", "90 minutes")) == want
    # Out of order by less than the delay: nothing is lost.
    near = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 40))
    assert rows_of(S.replay([frame(spark, near[:90]), frame(spark, near[90:])], "1 hour", "90 minutes")) == want


def test_repeats_count_once_in_a_window(spark):
    rows = [(1, "It may be true"), (2, "it may be TRUE  "), (59, "It may be true"), (61, "It may be true"), (5, "other"), (300, "end")]
    later = [(3, "It may be true"), (30, "it may be true"), (301, "end")]
    got = S.replay([frame(spark, rows[:4]), frame(spark, rows[4:5] + later[:2]), frame(spark, rows[5:] + later[2:])], "1 hour", "1 hour")
    counts = {r["window_start"].hour: r["total_samples"] for r in got.collect()}
    # All copies that clean to one text count once; the same text in the next hour counts again.
    clean = {r[0] for r in S.tagged(frame(spark, rows[:3] + later[:2])).select("text_key").collect()}
    assert counts == {0: len(clean) + 1, 1: 1}


def test_rows_behind_the_watermark_are_left_out(spark):
    first = [(10, "a b"), (200, "c d")]
    late = [(20, "too late"), (150, "in time"), (400, "end")]
    got = S.replay([frame(spark, first), frame(spark, late), frame(spark, [(401, "x")])], "1 hour", "1 hour")
    assert {(r["window_start"].hour, r["total_samples"]) for r in got.collect()} == {(0, 1), (2, 1), (3, 1)}


def test_odd_rows(spark):
    rows = [(None, "no time"), (5, None), (6, ""), (7, ""), (600, "end")]
    got = S.replay([frame(spark, rows), frame(spark, [])], "1 hour", "2 hours")
    assert rows_of(got) == rows_of(S.window_rates(frame(spark, rows), "1 hour", "2 hours"))
    assert [(r["window_start"].hour, r["total_samples"], r["total_tokens"], r["emotion_ratio"]) for r in got.collect()] == [(0, 1, 0, 0.0)]
    assert S.replay([frame(spark, [])], "1 hour", "2 hours").count() == 0
    with pytest.raises(ValueError, match="forgets"):
        S.once_per_window(S.tagged(frame(spark, rows)), "2 hours", "1 hour")
    with pytest.raises(ValueError, match="fixed length"):
        S.once_per_window(S.tagged(frame(spark, rows)), "1 hour", "1 month")


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    rates = lambda: S.stream_rates(S.read_claims(spark, str(tmp_path / "in"), SCHEMA), "1 hour", "1 hour")
    held = []
    for k in range(3):
        frame(spark, [(600 * k + m, t) for m, t in enumerate(texts(50, k))]).write.mode("append").parquet(str(tmp_path / "in"))
        query = S.run_available(rates(), str(tmp_path / "out"), str(tmp_path / "cp"))
        held.append(sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]))
    assert held[2] <= held[0] and spark.read.parquet(str(tmp_path / "out")).select(F.sum("total_samples")).first()[0] > 0
