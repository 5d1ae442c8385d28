"""Splittable quoted files against Spark's own multi-line reader, whatever the blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from claimwright.sources import readers, records as R

SCHEMA = StructType([StructField(c, StringType()) for c in "abcd"])


@pytest.fixture
def blocks_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def cut(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "16")

    yield cut
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def cell(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return '"' + rng.choice(["a\nb", 'x""y', "\n\n", '"",\n""', ",", "", "one\r\ntwo", "\n" * 5 + ","]) + '"'
    return 'mid"quote' if kind == 1 else rng.choice(["abc", "", "12", "é日本"])


def text_of(seed, n, end="\n"):
    rng = random.Random(seed)
    return end.join(",".join([str(i), *(cell(rng) for _ in range(3))]) for i in range(n)) + end


def plain(spark, path, **options):
    return [tuple(r) for r in spark.read.schema(SCHEMA).options(escape='"', multiLine=True, **options).csv(path).collect()]


def found(spark, path, **options):
    rows = R.read_records(spark, path, ",", **options).select("row_id", R.fields(F.col("record"), SCHEMA, ",").alias("f"))
    got = rows.select("row_id", "f.*").orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(len(got)))
    return [tuple(r)[1:] for r in got]


@pytest.mark.parametrize("size", [48, 200, 5000])
def test_equals_the_multi_line_reader(spark, tmp_path, blocks_of, size):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text(text_of(size, 300), newline="")
    want = plain(spark, path)
    blocks_of(size)
    assert R.lines(spark, path, ",").select("block").distinct().count() > 1
    assert found(spark, path) == want


def test_headers_blank_lines_and_several_files(spark, tmp_path, blocks_of):
    for name, seed in (("b", 1), ("a", 2)):
        (tmp_path / f"{name}.csv").write_text("a,b,c,d\n" + text_of(seed, 60).replace("\n7,", "\n\n\n7,"), newline="")
    (tmp_path / "empty.csv").write_text("a,b,c,d\n")
    (tmp_path / "none.csv").write_text("")
    want = plain(spark, str(tmp_path / "a.csv"), header=True) + plain(spark, str(tmp_path / "b.csv"), header=True)
    blocks_of(100)
    assert found(spark, str(tmp_path), header=True) == want
    rows = readers.read_header_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError, match="header"):
        readers.read_header_csv(spark, str(tmp_path), StructType([StructField(c, StringType()) for c in "axcd"]))


def test_one_field_over_many_blocks(spark, tmp_path, blocks_of):
    long = "\n".join(f'line {i} "" ,' for i in range(200))
    (tmp_path / "a.csv").write_text(f'0,x,y,z\n1,"{long}",b,c\n2,p,q,"r\n\ns"\n3,,,', newline="")
    blocks_of(64)
    got = found(spark, str(tmp_path / "a.csv"))
    assert got == [("0", "x", "y", "z"), ("1", long.replace('""', '"'), "b", "c"), ("2", "p", "q", "r\n\ns"), ("3", None, None, None)]


def test_windows_line_ends(spark, tmp_path, blocks_of):
    (tmp_path / "a.csv").write_bytes(b'0,"x\r\ny",b,c\r\n\r\n1,p,q,r\r\n')
    for size in (10, 1000):
        blocks_of(size)
        assert found(spark, str(tmp_path / "a.csv")) == [("0", "x\r\ny", "b", "c"), ("1", "p", "q", "r")]


def test_an_open_quote_reaches_to_the_end_of_its_file(spark, tmp_path, blocks_of):
    (tmp_path / "a.csv").write_text('0,"open,b,c\n1,x,y,z\n')
    (tmp_path / "b.csv").write_text("2,x,y,z\n")
    blocks_of(12)
    texts = [r["record"] for r in R.read_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ",").orderBy("row_id").collect()]
    assert texts == ['0,"open,b,c\n1,x,y,z', "2,x,y,z"]


def test_states_equal_a_loop():
    rng = np.random.default_rng(1)
    for _ in range(50):
        maps, start = rng.integers(0, 4, 30).astype(np.int8), bool(rng.integers(2))
        now, want = start, []
        for m in maps:
            want.append(now)
            now = bool((m >> int(now)) & 1)
        assert R.states(maps, start).tolist() == [*want, now]


def test_a_map_is_what_the_line_does(spark):
    cases = {"a,b": 2, '"a,b': 1 | 0, 'a"b,c': 2, '"a"": ,"': 0, '",': 1, "": 2, 'x,"y",z': 2, '""': 2}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", R.line_map(F.col("v"), ",").alias("m")).collect()

    def after(line, inside):
        for k, field in enumerate(line.split(",")):
            quotes = field.count('"')
            inside = (quotes % 2 == 0) if inside else (field.startswith('"') and quotes % 2 == 1)
        return inside

    assert all(r["m"] == after(r["v"], False) + 2 * after(r["v"], True) for r in rows)
