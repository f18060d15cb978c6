"""The grammar's round trip, random access, and the files against the library on whole texts."""

import random
import uuid
import zlib

import numpy as np
import pytest

from gradeframe.llm import grammar, pieces, token_files
from gradeframe.llm.common import shared_folder, tokenizer_path
from gradeframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def corpus(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 50_257, rng.integers(1, 40)) for _ in range(60)]
    docs = [np.concatenate([phrases[i] for i in rng.zipf(1.5, rng.integers(1, 60)) % 60]) for _ in range(300)]
    return docs + [np.full(5_000, 7), np.tile([7, 8], 3_000), np.array([2]), docs[0], docs[0]]


@pytest.mark.parametrize("least, gain", [(2, 0.0001), (16, 0.02)])
def test_shards_round_trip(monkeypatch, least, gain):
    monkeypatch.setattr(grammar, "LEAST", least)
    monkeypatch.setattr(grammar, "GAIN", gain)
    monkeypatch.setattr(grammar, "STRIDE", 16)
    docs = corpus(1)
    sizes, ids = np.array(list(map(len, docs))), np.concatenate(docs)
    names = [None if i % 50 == 0 else i - 100 for i in range(len(docs))]
    data = grammar.write_shard(names, sizes, ids, 50_257)
    shard = grammar.Shard(data)
    assert shard.doc_ids == names and np.array_equal(shard.all_ids(), ids) and len(data) < 2 * len(ids)
    assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(docs))
    rng = random.Random(2)
    for _ in range(300):
        a = rng.randint(0, len(ids))
        b = rng.randint(a, min(len(ids), a + rng.choice([0, 1, 5, 4_000])))
        assert np.array_equal(shard.range(a, b), ids[a:b])


def test_rules_name_earlier_rules_and_stay_within_documents():
    docs = corpus(3)
    ids, last = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum(list(map(len, docs))) - 1] = True
    symbols, rules, lengths = grammar.compress(ids, last, 50_257)
    assert (rules < 50_257 + np.arange(len(rules))[:, None]).all() and len(rules) > 10
    assert [len(grammar.expand(np.array([50_257 + i]), rules, 50_257)) for i in range(len(rules))] == lengths.tolist()
    size = np.where(symbols < 50_257, 1, np.concatenate([lengths, [0]])[np.maximum(symbols - 50_257, -1)])
    assert set((np.flatnonzero(last) + 1).tolist()) <= set(np.cumsum(size).tolist())


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        grammar.Shard(b"x" * 100)


def wanted_rows(docs):
    tokenizer = pieces.load_tokenizer(tokenizer_path(token_files.BYTE_TOKENIZER))
    start, rows = 0, []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_files_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_token_files"](spark, FOLDER).collect()))
    assert got == wanted_rows(sorted(docs))


def test_small_shards_in_several_tasks(spark):
    rng = random.Random(4)
    docs = [(i - 50, rng.choice([None, "", "a b <|endoftext|> c", "word " * rng.randint(0, 900), "\u00e9\u4e2d \n\n x"])) for i in range(200)]
    rng.shuffle(docs)
    path = f"{shared_folder(spark)}/test-ids-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_ids(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), path, shard_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = token_files.read_shards(spark, path)
    assert shards.select("part").distinct().count() > 3 and shards.count() > 20
    assert sorted(map(tuple, token_files.describe(shards).collect())) == wanted_rows(sorted(docs))
    tokenizer = pieces.load_tokenizer(tokenizer_path(token_files.BYTE_TOKENIZER))
    texts = dict(docs)
    for r in token_files.read_ids(shards).collect():
        assert r.ids == [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
