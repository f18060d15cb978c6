"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeframe.llm import (
    alignment, exact_dedup, language, mixing, near_join, negatives, packing, pii, secrets,
    suffix_dedup, token_counts, token_files, topk,
)
from gradeframe.llm.common import keep_rows, shared_folder



def token_files_of(docs):
    path = f"{shared_folder(docs.sparkSession)}/test-ids-{uuid.uuid4().hex}"
    token_files.write_ids(docs, path, shard_ids=1_000)
    return token_files.describe(token_files.read_shards(docs.sparkSession, path))


OPERATORS = {
    "secrets": (secrets.scan_secrets, "doc_id n_assign n_access n_hex base_sha256 spans"),
    "suffix_dedup": (suffix_dedup.remove_repeats, "doc_id n_bytes n_removed n_spans kept_sha256"),
    "token_counts": (token_counts.token_counts, "doc_id n_bytes n_tokens over_limit"),
    "language": (language.identify, "doc_id held_out lang_pred score"),
    "exact_dedup": (exact_dedup.exact_dedup, "doc_id keep_id group_size kept text_sha256"),
    "mixing": (mixing.mix, "doc_id size source_size target taken"),
    "packing": (packing.pack, "doc_id piece start length ids_crc32 sequence_id offset"),
    "near_join": (near_join.near_join, "doc_id class_id class_size n_links kept text_hash"),
    "alignment": (alignment.align, "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "token_files": (token_files_of, "doc_id start n_tokens ids_crc32"),
    "pii": (pii.find_personal_data, "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, row string, sid string"
ROWS = [
    (1, "one two three four five six", "en", "a", 1, "x", None, "r", "s"),
    (1, "one two three four five six", "en", "a", 1, "x", None, "r", "s"),  # a repeated row
    (1, "another text with the same id", "en", "a", 1, None, None, None, None),
    (2, None, None, None, None, None, None, None, None),
    (None, "one two  three\nfour five six", None, "b", 3, None, None, None, None),
    (None, None, "en", "b", None, None, None, None, None),
    (3, "", "de", None, 0, None, None, None, None),
    (4, " \t\n", "de", "", 3, None, None, None, None),
    (5, "lang " * 60_000, "en", "a", 9, None, None, None, None),  # very long
    (6, "x" * 150_000, "xx", "a", 9, None, None, None, None),  # one word, one byte repeated
    (7, "😀 ÀÉ ß 'S <|endoftext|> 12.34.56.78", "fr", "c", 9, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, name):
    operator, columns = OPERATORS[name]
    got = operator(docs)
    assert got.columns == columns.split()
    rows = got.collect()
    if name == "packing":
        rows = [r for r in rows if r.piece == 0]
    ids = lambda values: sorted(values, key=lambda v: (v is None, v or 0))
    assert ids(r.doc_id for r in rows) == ids(r[0] for r in ROWS)
    again = [r for r in rows if r.doc_id == 1]
    assert len(again) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    operator, columns = OPERATORS[name]
    got = operator(docs.where("false"))
    assert got.columns == columns.split() and got.collect() == []


def test_stages_keep_the_columns(spark, docs, tmp_path):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for table in (docs, docs.where("false")):
            out = stage(spark, table, str(tmp_path))
            assert out.schema == docs.schema
            assert number or not {r.doc_id for r in out.collect()} & {2, 3, 4}


def test_repeated_rows_are_kept_once(docs):
    kept = exact_dedup.keep_first(docs).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 2, 4, 5, 6, 7]  # a lone space is not empty
    assert sum(r.text == "one two three four five six" for r in kept) == 1
    one = near_join.keep_one_of_each(docs).collect()
    assert sum((r.text or "").split() == "one two three four five six".split() for r in one) == 1


def test_keep_rows_takes_the_named_text_only(docs):
    wanted = docs.where("text = 'another text with the same id'").select("doc_id", F.xxhash64("text").alias("tag"))
    assert [r.text for r in keep_rows(docs, wanted, F.xxhash64("text")).collect()] == ["another text with the same id"]


VECTORS = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [3.0, 0.5], 2), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, None, 1),
           (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (20, [1.0], 1),
           (40, [], 1), (60, [0.1, 0.1], 1), (61, [0.9, 0.1], None)]


def test_top_k_edges(spark):
    table = topk.quantized(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, score int"))
    got = topk.top_k(table, table.where("vec_id % 20 = 0"), 3).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    # Three rows of id 0 ask, and find the other two but not themselves; a tie goes to the smaller id.
    plain, other = [(1, 0, 13312), (2, 1, 8192), (3, 2, 8192)], [(1, 1, 24576), (2, 2, 24576), (3, 0, 13312)]
    assert mine == sorted(plain + plain + other)
    assert {r.query_id for r in got} == {0, 60}  # no vector of the length of 20 and 40
    assert topk.top_k(table.where("false"), table.where("false"), 2).collect() == []


def test_negatives_edges(spark):
    table = negatives.labelled(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int, score int"
                                                     .replace(", score int", "")), 4)
    got = negatives.hard_negatives(table, table.where("vec_id = 0"), 2, 2, 50, 100).collect()
    rows = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)
    # Both plain rows of id 0 have the positives 1 (32) and 0 (20); the third row of id 0 has 2 (96).
    plain = [(0, 1, 1, 2, 32, 32)]
    third = [(0, 2, 1, 1, 96, 96), (0, 2, 2, 0, 96, 52), (0, 2, 2, 0, 96, 52)]
    assert [r for r in rows if r[4] == 32] == plain * 2
    assert [r for r in rows if r[4] == 96] == third[:2]
    empty = table.where("false")
    assert negatives.hard_negatives(empty, empty).collect() == []
    assert negatives.hard_negatives(table, empty).collect() == []
    assert negatives.hard_negatives(table.where("label = 1"), table.where("label = 1")).collect() == []


def test_language_stage_keeps_texts_when_nothing_could_be_learned(docs):
    kept = lambda table: sorted(str(r) for r in language.keep_known(table).select("doc_id", "text").collect())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held = docs.withColumn("lang", F.when(language.held_out(), "en"))
    assert kept(unlabelled) == kept(held) == kept(docs)
    assert len(kept(unlabelled)) == sum(any(map(str.isalpha, r[1] or "")) for r in ROWS) > 0
