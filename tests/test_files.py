import json

import pytest
from pyspark.sql import functions as F

from claimwright import schemas
from claimwright.operators import concept_rows
from claimwright.functions import concepts as C
from claimwright.sources import readers, sinks, versions


def _line(*cells):
    return "\t".join(cells) + "\n"


def test_tsv_quotes_nulls_and_order(spark, tmp_path):
    tail = ["1", "2", "0", "", "4"]
    (tmp_path / "train.tsv").write_text(
        _line("1", "true", '"a ""quoted""\ttab"', "tax", "ann", "j", "s", "none", *tail, "tv")
        + _line("2", "false", "plain", "NA", "bob", "j", "s", "green", *tail, "null")
    )
    (tmp_path / "test.tsv").write_text(_line("3", "true", "last", "x", "y", "j", "s", "p", *tail, "c"))
    got = readers.read_political_tsv(spark, [str(tmp_path / "train.tsv"), str(tmp_path / "test.tsv")])
    rows = got.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert [r["statement"] for r in rows] == ['a "quoted"\ttab', "plain", "last"]
    assert rows[1]["subject"] is None and rows[1]["context"] is None and rows[0]["party"] == "none"
    assert rows[0]["mostly_true_count"] is None and rows[0]["pants_fire_count"] == 4.0
    assert set(got.columns) == {"row_id", *schemas.POLITICAL_COLUMNS}


def test_row_ids_across_blocks(spark, tmp_path):
    for name, n in (("b.csv", 3000), ("a.csv", 2000)):
        (tmp_path / name).write_text("".join(f"{name}-{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = spark.read.schema("x string").csv(str(tmp_path))
        rows = readers.with_row_id(scan, F.col("_metadata.file_name"), ["x"]).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"a.csv-{i}" for i in range(2000)] + [f"b.csv-{i}" for i in range(3000)]
    assert [r["row_id"] for r in rows] == list(range(5000)) and [r["x"] for r in rows] == want


@pytest.mark.parametrize(
    "name, expected",
    [
        ("NewsFakeCOVID-19.csv", ("news", "fake")),
        ("05-01_ClaimRealCOVID-19.csv", ("claim", "real")),
        ("ClaimNewsFakeCOVID-19.csv", (None, None)),
        ("NewsCOVID-19.csv", (None, None)),
    ],
)
def test_snapshot_names(spark, name, expected):
    frame = spark.createDataFrame([(name,)], "n string")
    assert tuple(frame.select(*readers.classify_snapshot(F.col("n"))).first()) == expected


def test_snapshots_skip_bad_files(spark, tmp_path):
    (tmp_path / "b_NewsFakeCOVID-19.csv").write_text('id,title\n1,"x, y"\n2,\n')
    (tmp_path / "a_ClaimRealCOVID-19.csv").write_text("title,other\nfirst,1\nNA,2\n")
    (tmp_path / "ClaimNewsFakeCOVID-19.csv").write_text("title\nboth\n")
    (tmp_path / "NewsRealCOVID-19.csv").write_text("headline\nno title column\n")
    got = readers.read_snapshots(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r["statement"], r["subset"], r["label"]) for r in got] == [
        ("first", "claim", "real"), (None, "claim", "real"), ("x, y", "news", "fake"), (None, "news", "fake"),
    ]
    with pytest.raises(FileNotFoundError):
        readers.read_snapshots(spark, str(tmp_path / "nothing"))


def test_materialize_rebuilds_only_when_stale(spark, tmp_path):
    path = str(tmp_path / "cache")
    frame = spark.range(5).select(F.col("id").alias("row_id"), F.array(F.lit(1), F.lit(2)).alias("v"))
    assert sinks.materialize(frame, path, width="v")[1]
    assert not sinks.materialize(frame, path, width="v")[1]
    wider = frame.withColumn("v", F.array(F.lit(1), F.lit(2), F.lit(3)))
    assert sinks.materialize(wider, path, width="v")[1]
    assert sinks.materialize(wider, path, width="v", overwrite=True)[1]
    same_count = wider.withColumn("row_id", F.col("row_id") + 1)
    table, wrote = sinks.materialize(same_count, path, width="v")
    assert wrote and table.agg(F.sum("row_id")).first()[0] == 15


def test_log_survives_a_broken_line(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark, path, "a", {"x": 1})
    sinks.append_log(spark, path, "a", {"x": 2})
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    rows = sinks.read_log(spark, path).collect()
    assert [(r["step"], r["metrics"]["x"]) for r in rows] == [("a", "2")]


def test_results_glob(spark, tmp_path):
    for seed in (41, 42):
        record = {"phase": 4, "seed": seed, "test_macro_f1": 0.5 + seed / 1000,
                  "test_per_domain": {"political": {"n": 3, "acc": 0.5, "macro_f1": 0.4}}}
        (tmp_path / f"run_seed{seed}.json").write_text(json.dumps(record, indent=2))
    rows = readers.read_results(spark, str(tmp_path / "run_seed*.json")).collect()
    assert {r["seed"] for r in rows} == {41, 42}
    assert rows[0]["test_per_domain"]["political"]["n"] == 3


def test_variants_are_one_folder_per_length_and_split(spark, tmp_path):
    frame = spark.range(20).select(
        F.col("id").alias("row_id"), F.lit(128).alias("L"),
        F.when(F.col("id") < 15, "train").otherwise("test").alias("split"),
    )
    sinks.write_variants(frame, str(tmp_path / "v"))
    (folder,) = (tmp_path / "v").glob("data-*/L=128")
    assert {p.name for p in folder.iterdir()} == {"split=train", "split=test"}
    assert versions.read(spark, str(tmp_path / "v")).filter("split = 'test'").count() == 5


def test_schema_check(spark):
    with pytest.raises(ValueError):
        schemas.check_schema(spark.range(1), schemas.EPOCH)


def test_join_form_equals_fold_form(spark):
    lex = C.Lexicon()
    rows = [(1, "They did not ever really say the big car , maybe it is n't true now".split()),
            (2, "no no ( without doubt ) could — should `FAILED' be".split())]
    frame = spark.createDataFrame(rows, "row_id long, t array<string>")
    fold = {r[0]: r[1] for r in frame.select("row_id", C.concept_tags(F.col("t"), lex)).collect()}
    table = concept_rows.tag_table(frame, "t", concept_rows.lexicon_table(spark, lex))
    got = {}
    for r in table.orderBy("row_id", "pos").collect():
        got.setdefault(r["row_id"], []).append(r["tag"])
    assert got == fold


def test_row_local_steps_run_on_a_stream(spark, tmp_path):
    from claimwright.functions import text as T

    source = tmp_path / "in"
    spark.createDataFrame([("it is NOT so!!",), ("5 maybe",)], "statement string").write.parquet(str(source))
    stream = spark.readStream.schema("statement string").parquet(str(source))
    tagged = stream.select(
        "statement", C.concept_tags(T.tokenize(T.clean_basic(F.col("statement")))).alias("tags")
    )
    q = (
        tagged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination(120)
    rows = {r["statement"]: r["tags"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["it is NOT so!!"] == ["O", "O", "O", "NEGATION", "NEGATION_SCOPE", "O"]
    assert rows["5 maybe"] == ["O", "MODALITY"]


def test_tsv_keeps_quoted_line_breaks_and_path_order(spark, tmp_path):
    tail = ["1", "2", "0", "3", "4", "tv"]
    for folder, who in (("b", "first"), ("a", "second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "train.tsv").write_text(_line("1", "true", f'"{who}\nclaim"', "s", "x", "j", "s", "p", *tail))
    paths = [str(tmp_path / "b" / "train.tsv"), str(tmp_path / "a" / "train.tsv")]
    rows = readers.read_political_tsv(spark, paths).orderBy("row_id").collect()
    assert [(r["row_id"], r["statement"]) for r in rows] == [(0, "first\nclaim"), (1, "second\nclaim")]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_political_tsv(spark, paths, multi_line=False).collect()


def test_snapshots_keep_line_breaks_and_fail_on_corrupt_files(spark, tmp_path):
    import gzip

    (tmp_path / "NewsFakeCOVID-19.csv").write_text('id,title\n1,"two\nlines"\n2,x\n')
    (tmp_path / "NewsRealCOVID-19.csv").write_text("headline\nnone\n")
    assert {r["statement"] for r in readers.read_snapshots(spark, str(tmp_path)).collect()} == {"two\nlines", "x"}
    report = {r["source_file"]: (r["rows"], r["skipped"]) for r in readers.snapshot_report(spark, str(tmp_path)).collect()}
    assert report == {"NewsFakeCOVID-19.csv": (2, None), "NewsRealCOVID-19.csv": (None, "no column title")}
    folder = tmp_path / "ClaimRealCOVID-19.csv"
    folder.mkdir()
    packed = gzip.compress("title\n".encode() + b"".join(b"claim %d %d\n" % (i, i * i) for i in range(20000)))
    (folder / "part.csv.gz").write_bytes(packed[: len(packed) // 2])
    with pytest.raises(Exception):
        readers.read_snapshots(spark, str(tmp_path)).collect()


def test_results_in_any_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tag": "x", "seed": 1, "test_per_domain": {"d": {"n": 1, "acc": 0.5, "macro_f1": 0.5}}}, indent=2))
    (tmp_path / "b.json").write_text('{"tag": "y", "seed": 2}\n{"tag": "z", "seed": 3}\n')
    rows = readers.read_results(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r["tag"], r["seed"]) for r in rows) == [("x", 1), ("y", 2), ("z", 3)]


def test_materialize_sees_changed_values(spark, tmp_path):
    frame = spark.range(5).select(F.col("id").alias("row_id"), F.lit("old").alias("v"))
    path = str(tmp_path / "cache")
    assert sinks.materialize(frame, path)[1] and not sinks.materialize(frame, path)[1]
    table, wrote = sinks.materialize(frame.withColumn("v", F.lit("new")), path)
    assert wrote and table.first()["v"] == "new"


def test_cleaning_counts_come_after_markup(spark):
    from claimwright.operators import summaries

    raw = '<a href="http://x.co">see</a> \U0001f600 www.y.z'
    row = summaries.cleaning_summary(spark.createDataFrame([(raw, "see")], "a string, b string"), "a", "b").first()
    assert (row["urls_replaced"], row["emojis_mapped"]) == (1, 1)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from claimwright import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_a_cut_result_record_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"accuracy": 0.5}\n{"accuracy": 0.6}\n{"accuracy": 0.')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_results(spark, str(tmp_path / "r.json")).collect()
