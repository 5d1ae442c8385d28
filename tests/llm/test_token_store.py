import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimwright.llm import token_store
from claimwright.llm.mphf import PerfectHash

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_perfect_hash_numbers_keys_without_gaps():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2**63, 20000).astype(np.uint64)
    second = rng.integers(0, 2**63, 20000).astype(np.uint64)
    first[:3] = first[0]  # equal first hashes are told apart by the second
    perfect, cols = PerfectHash.load(PerfectHash.build(first, second).dump({"x": np.arange(3)}))
    assert sorted(perfect.numbers(first, second)) == list(range(20000)) and list(cols["x"]) == [0, 1, 2]
    assert PerfectHash.build(first[:0], second[:0]).size == 0


def test_word_cache_gives_the_library_s_ids(library):
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\n\n", "'s", "'ll", "é", "Ñandú", "12", "3.5", "!!", "&&&", "<|endoftext|>", "x'T", "_", "-", "a b", "中", "\t", "\u00a0", "😀", "٣", "²"]
    encoder = token_store.WordEncoder(BPE, special_as_text=True)
    for k in range(3000):
        pool = parts if k % 3 else parts[:17]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 15)))
        got = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_tokens_are_those_of_the_untouched_library(docs_of, tmp_path):
    plain = Tokenizer.from_file(BPE)
    encoder = token_store.encoder_for(BPE)
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "one", " ", "  ", "\n", "'s", "é", "12", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    for text in ["one <|endoftext|> two", *texts]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want, repr(text)
    rows = [(1, "one <|endoftext|> two"), (2, "next")]
    store = token_store.write_store(docs_of(rows), str(tmp_path / "s"), BPE)
    got = store.read(store.directory.select("key", "rank"), with_ids=True).orderBy("key").collect()
    assert [(r["start"], r["ids"]) for r in got] == [(0, [505, 220, 50256, 734, 0]), (5, [*plain.encode("next").ids, 0])]


def test_store_reads_back_what_the_library_encodes(spark, docs_of, library, tmp_path):
    rows = [(9, "b c"), (2, None), (5, ""), (7, "word " * 30000), (5, "again"), (None, "null key"), (-3, "é中 😀")]
    store = token_store.write_store(docs_of(rows), str(tmp_path / "s"), BPE)
    got = store.read(store.directory.select("key", "rank"), with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for key, text in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    have = sorted(((r["key"], r["start"], r["n_ids"], r["ids_crc32"], r["ids"]) for r in got), key=lambda r: r[1])
    assert have == want
    assert store.lookup(9).tolist() == library.encode("b c").ids + [0]
    assert store.lookup(12345) is None and store.lookup(5, 1).tolist() == library.encode("again").ids + [0]


def test_foreign_keys_are_not_found(spark, docs_of, tmp_path):
    store = token_store.write_store(docs_of([(i, f"t{i}") for i in range(300)]), str(tmp_path / "s"), BPE)
    keys = spark.range(5000).selectExpr("id as key", "0L as rank")
    assert store.find(keys).where("shard >= 0").count() == 300


def test_empty_table(docs_of, tmp_path):
    store = token_store.write_store(docs_of([]), str(tmp_path / "s"), BPE)
    assert store.read(store.directory.select("key", "rank")).count() == 0
    assert store.lookup(1) is None


def test_plain_folders_belong_to_the_default_file_system(spark, monkeypatch):
    assert token_store.qualified(spark, "/tmp/x/y") == "file:///tmp/x/y"
    assert token_store.qualified(spark, "file:/tmp/x") == "file:///tmp/x"
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="shared"):
        token_store.qualified(spark, "/shared/x")
    assert token_store.qualified(spark, "file:///shared/x") == "file:///shared/x"


def test_query_runs_where_the_shared_folder_is_named_by_a_plain_path(spark, docs_of, tmp_path, monkeypatch):
    from claimwright import session
    from claimwright.llm.queries import QUERIES

    docs_of([(1, "one two"), (2, "next"), (None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert QUERIES["op3_token_store"](spark, str(tmp_path)).count() == 3
    assert [p.suffix for p in (tmp_path / "shared/claimwright").glob("token-store-*/ids-*")].count(".bin") >= 1
