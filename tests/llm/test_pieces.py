"""Ids by pieces against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gradeframe.llm import pieces, token_counts
from gradeframe.llm.common import tokenizer_path

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
# Letters that change their length in lower case, combining marks, signs between letters, special strings in
# every case, and white space of every kind.
ALPHABET = [
    *"\u0130\u0131\u017f\ufb01\u212a\u212b\u00e9\u00c9\u00d7\u00f7\u00df\u1e9e\u03a3\u03c2\u00b2\u00bd\u0661\u4e2d\U0001f600\u200d",
    "A\u030a", "T\u0308", "\u1e97", "e\u0301", "\u1eb8\u0301", "i\u0307", "\u0338", "\u0301", "KAD\u0130!", "AL\u0130, VEL\u0130.",
    "'s", "'S", "'t", "'", "can't", "CAN'T", "don\u2019t", *".,!?-=<>|\"()", "--", "...", "<|endoftext|>", "<|ENDOFTEXT|>",
    "<|startoftext|>", "<|", "|>", "12", "3.14", "4\u00e9", "a1b", "foo", "Foo", "BAR", "\0", "\x7f", "\ufeff",
    *"\u0085\u00a0\u1680\u2003\u2028\u3000\x1c\x1f\t\n\r\v\f", "\n\n", "\r\n", " ", " ", " ", "  ", "   ", "\n ", " \n",
]


def random_texts(seed, count):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(count)]


@pytest.mark.parametrize("file", FILES)
def test_ids_of_random_texts(file):
    texts = random_texts(3, 10_000) + [None]
    cache = pieces.PieceIds.of(tokenizer_path(file))
    ids, ends = cache.encoded(pa.array(texts))
    wanted = cache.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    wrong = [t for t, e, a, b in zip(texts, wanted, ends, ends[1:]) if e.ids != ids[a:b].tolist()]
    assert wrong == [] and len(ends) == len(texts) + 1 and ends[-1] == len(ids)


@pytest.mark.parametrize("file", FILES)
def test_forgetful_cache_and_parts(file, monkeypatch):
    texts = pa.array(["x", *random_texts(4, 600), None, "last"]).slice(1)
    path = tokenizer_path(file)
    whole = pieces.PieceIds.of(path).encoded(texts)[0]
    small = pieces.PieceIds.of(path, entries=40)
    parts = list(pieces.parts_of(texts, 1_000))
    assert len(parts) > 5 and [at for at, _ in parts] == np.cumsum([0, *(len(t) for _, t in parts)])[:-1].tolist()
    assert np.array_equal(np.concatenate([small.encoded(t)[0] for _, t in parts]), whole)
    frequent = {b" foo": len(small.tokenizer.encode(" foo").ids), b"foo": 1}
    counts = token_counts.PieceCounts.of(path, frequent=frequent, entries=40)
    assert sum(int(counts.counted(t).sum()) for _, t in parts) == len(whole)


def test_counts_of_random_texts(spark):
    texts = random_texts(5, 2_000)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    tokenizer = pieces.load_tokenizer(tokenizer_path())
    wanted = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == wanted


def test_summary_is_bounded_and_holds_what_is_frequent():
    rng = np.random.default_rng(1)
    summary, seen = token_counts.Summary(50), {}
    for _ in range(20):
        words = [b"hot", b"warm"] * 300 + [b"w%d" % i for i in rng.integers(0, 5_000, 1_000)]
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        summary.add(pa.array(words, pa.large_binary()))
        assert len(summary.counts) <= 50
    for word, n in seen.items():
        assert n - summary.lost <= summary.counts.get(word, 0) <= n
    assert {b"hot", b"warm"} <= set(summary.counts)
