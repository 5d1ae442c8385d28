import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_near_dup import brute as linked

from claimwright.llm import pieces
from claimwright.llm.common import without
from claimwright.llm.queries import quality_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage over the smallest table with odd rows added."""
    rows = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "", None, None, None), (10**6 + 3, "\t", "en", "s", 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_filtering_stages_keep_columns_and_rows_as_they_are(stages):
    before = stages["documents"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == before.columns
        assert stages[name].exceptAll(before).count() == 0
        before = stages[name]


def test_quality_stage_keeps_exactly_the_rows_with_a_good_score(spark, stages):
    scores = quality_scores(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    want = {r["doc_id"] for r in scores if r["score"] >= 0.3}
    assert set(texts(stages["quality"])) == want
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert good <= want and len(want) < len(scores)


def test_exact_dedup_against_brute_force(stages):
    before, first = texts(stages["quality"]), {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
    assert set(texts(stages["exact_dedup"])) == set(first.values())


def test_near_dedup_against_brute_force(stages):
    rows = sorted(texts(stages["exact_dedup"]).items())
    assert set(texts(stages["near_dedup"])) == {i for i, class_id, _, _ in linked(rows) if i == class_id}


def test_decontamination_against_brute_force(spark, stages):
    plain = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, kept = texts(stages["near_dedup"]), texts(stages["decontamination"])
    leaks = {i for i, t in before.items() if any(x and x in plain(t) for x in items)}
    assert set(kept) == set(before) - leaks


def test_tokens_round_trip(stages):
    kept = texts(stages["decontamination"])
    vocabulary = pieces.encoder_for(public_tokenizers.path("piece_bpe_32k.model")).v
    rows = stages["tokens"].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(kept)
    for r in rows:
        text = kept[r["doc_id"]] or ""
        assert pieces.decode_ids(np.array(r["ids"], np.int32), vocabulary) == text
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) and r["n_ids"] == len(r["ids"])


def test_without_handles_nulls_repeats_and_clashing_columns(spark, docs_of):
    rng = random.Random(0)
    rows = [(rng.choice([None, *range(60)]), f"t{k}") for k in range(300)]
    ids = spark.createDataFrame([(None,), (3,), (3,), (59,), (1000,)], "doc_id bigint")
    got = without(docs_of(rows), ids)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(r for r in rows if r[0] not in (None, 3, 59))
    assert got.columns == docs_of(rows).columns
    assert without(docs_of(rows), ids.limit(0)).count() == 300 and without(docs_of([]), ids).count() == 0
