"""Versioned tables: a half-done write changes nothing, and a table is computed once."""

import threading

import pytest
from pyspark.sql import functions as F

from claimwright.operators import align
from claimwright.sources import readers, sinks, versions


def rows(spark, n, shift=0):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") + shift).alias("v"))


def failing(frame, at):
    return frame.withColumn("v", F.when(F.col("row_id") == at, F.raise_error(F.lit("stopped"))).otherwise(F.col("v")))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    sinks.write_stage(rows(spark, 10), path, fmt)
    reader = readers.read_header_csv(spark, path, rows(spark, 1).schema) if fmt == "csv" else versions.read(spark, path)
    with pytest.raises(Exception, match="stopped"):
        sinks.write_stage(failing(rows(spark, 1000, 5).repartition(4), 999), path, fmt)
    assert versions.current(spark, path).number == 1
    sinks.write_stage(rows(spark, 3, 7), path, fmt)
    assert reader.count() == 10 and reader.agg(F.sum("v")).first()[0] == 45
    now = readers.read_header_csv(spark, path, rows(spark, 1).schema) if fmt == "csv" else versions.read(spark, path)
    assert sorted(r["v"] for r in now.collect()) == [7, 8, 9]


def test_a_table_may_be_made_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_stage(rows(spark, 4), path)
    for _ in range(3):
        sinks.write_stage(versions.read(spark, path).withColumn("v", F.col("v") + 1), path)
    assert sorted(r["v"] for r in versions.read(spark, path).collect()) == [3, 4, 5, 6]
    assert sorted(r["v"] for r in versions.read(spark, path, 2).collect()) == [1, 2, 3, 4]


def test_writers_at_once_all_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [versions.stage(path, rows(spark, k + 1).write.parquet) for k in range(6)]
    threads = [threading.Thread(target=versions.commit, args=(spark, path, d, "parquet")) for d in data]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = [versions.current(spark, path, n) for n in range(1, 7)]
    assert {v.data for v in found} == set(data) and versions.current(spark, path) == found[-1]


def test_entries_are_never_half_read(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None and versions.location(spark, path) == path
    sinks.write_stage(rows(spark, 2), path)
    (tmp_path / "t" / "_manifest" / ".draft-x").write_text('{"number": 2, "da')
    (tmp_path / "t" / "data-dead").mkdir()
    assert versions.current(spark, path).number == 1 and versions.read(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_expire_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        sinks.write_stage(rows(spark, k + 1), path)
    assert versions.expire(spark, path, keep=2) == [1, 2]
    assert len(list((tmp_path / "t").glob("data-*"))) == 2
    assert versions.read(spark, path, 3).count() == 3 and versions.read(spark, path).count() == 4
    with pytest.raises(ValueError):
        versions.read(spark, path, 1)
    with pytest.raises(ValueError):
        versions.expire(spark, path, keep=0)
    with pytest.raises(ValueError):
        versions.discard(spark, path, versions.current(spark, path).data)


def test_materialize_computes_its_input_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    frame = rows(spark, 40).mapInArrow(counted, "row_id long, v long")
    assert sinks.materialize(frame, path, stamp="a")[1] and calls.value == 40
    table, wrote = sinks.materialize(frame, path, stamp="a")
    assert not wrote and calls.value == 40 and table.count() == 40
    assert not sinks.materialize(frame, path, stamp="b")[1] and calls.value == 80
    assert not sinks.materialize(frame, path, stamp="b")[1] and calls.value == 80
    assert not sinks.materialize(frame, path)[1] and calls.value == 120
    assert len(list((tmp_path / "t").glob("data-*"))) == 1
    empty = spark.createDataFrame([], "row_id long, v array<int>")
    assert sinks.materialize(empty, path, width="v")[1] and not sinks.materialize(empty, path, width="v")[1]


def test_observed_and_plain_fingerprints_agree(spark, tmp_path):
    frame = rows(spark, 25).withColumn("w", F.array("v", "row_id"))
    sinks.materialize(frame, str(tmp_path / "t"), width="w")
    assert versions.current(spark, str(tmp_path / "t")).note["fingerprint"] == sinks.fingerprint(frame, "row_id", "w").first().asDict()


def parts(spark, tmp_path, buckets=(4, 4, 4)):
    paths = [str(tmp_path / f"part{k}") for k in range(3)]
    for k, (path, n) in enumerate(zip(paths, buckets)):
        frame = rows(spark, 60 + 10 * k, k).withColumnRenamed("v", f"v{k}")
        versions.replace_bucketed(frame, path, "row_id", n)
    return paths


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_parts_join_without_a_shuffle(spark, tmp_path):
    paths = parts(spark, tmp_path)
    joined = align.join_stored_parts(spark, paths)
    plain = align.join_parts([versions.read(spark, p) for p in paths])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect())) and joined.count() == 60
    plan = plan_of(joined)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    assert "Exchange" in plan_of(plain)


def test_another_session_finds_the_buckets(spark, tmp_path):
    paths = parts(spark, tmp_path)
    for path in paths:
        folder = versions.location(spark, path)
        spark.sql(f"DROP TABLE {versions._table_name(folder)}")
    assert "Exchange" not in plan_of(align.join_stored_parts(spark, paths))
    assert align.join_stored_parts(spark, paths).count() == 60


def test_parts_of_other_layouts_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="buckets"):
        align.join_stored_parts(spark, parts(spark, tmp_path, (4, 8, 4)))
    sinks.write_stage(rows(spark, 3), str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="buckets"):
        versions.read_bucketed(spark, str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="buckets"):
        align.join_stored_parts(spark, [str(tmp_path / "plain")])
