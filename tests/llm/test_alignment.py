"""Alignment of two vocabularies against loops over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gradeframe.llm import alignment, pieces
from gradeframe.llm.common import tokenizer_path
from gradeframe.llm.queries import QUERIES
from test_pieces import random_texts

FOLDER = "/root/testdata/sf0.001"
MORE = ["\u2581", "a\u2581b", "<s>", "<0x41>", "<unk>", "thnereon", "leellepa,", " \u00e9l\u00e9a.", "St.", "e.g.", "word's", "\t", "x\0y"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, alphabet


def tokens_of(text, tools):
    """(id, start, end) of the tokens of A and of B over the bytes of space and text; None without tokens."""
    a, b, alphabet = tools
    if not text:
        return None
    data, sides = (" " + text).encode(), []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    named = [[(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a_ids],
             [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode())
              for i in b.encode(text)]]
    for tokens in named:
        if b"".join(t for _, t in tokens) != data:
            return None
        at, side = 0, []
        for i, t in tokens:
            side.append((i, at, at + len(t)))
            at += len(t)
        sides.append(side)
    return sides


def brute(texts, tools):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    counts, found = collections.Counter(), []
    for text in texts:
        sides = tokens_of(text, tools)
        if sides is None:
            found.append(None)
            continue
        links, j = [], 0
        a_side, b_side = sides
        for i, start, end in a_side:
            while b_side[j][2] <= start:
                j += 1
            k = j
            while k < len(b_side) and b_side[k][1] < end:
                links.append((i, b_side[k][0]))
                k += 1
        ends = np.array(sorted({t[2] for t in a_side} & {t[2] for t in b_side}))
        number = lambda t: np.searchsorted(ends, t[2])  # noqa: E731, B023
        groups = [[[], []] for _ in ends]
        for n, side in enumerate(sides):
            for t in side:
                groups[number(t)][n].append(str(t[0]))
        text_of = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        counts.update(links)
        found.append((len(a_side), len(b_side), len(ends), links, hashlib.sha256(text_of.encode()).hexdigest()))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4])
        for f in found]


def rows_of(table):
    return {r.doc_id: tuple(r)[1:] for r in table.collect()}


def test_documents(spark, tools):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = rows_of(QUERIES["op13_alignment"](spark, FOLDER))
    assert got == dict(zip(docs, brute(docs.values(), tools)))
    assert sum(r[0] for r in got.values()) > 10_000


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_odd_texts_and_pairs_outside_the_table(spark, tools, frequent):
    rng = random.Random(frequent)
    texts = [t + rng.choice(["", " "]) + rng.choice(MORE) if i % 3 == 0 else t for i, t in enumerate(random_texts(7, 900))]
    texts += [None, "", " ", "  ", "a", "x" * 5_000, "\n", "the the the " * 400, " lead", "trail  "]
    got = rows_of(alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3),
                                  frequent=frequent))
    wanted = brute(texts, tools)
    wrong = [(t, got[i], w) for i, (t, w) in enumerate(zip(texts, wanted)) if got[i] != w]
    assert wrong == [] and sum(w[0] == 0 for w in wanted) > 5
    # Regular groups are one A and one B token, so irregular links are there too.
    assert any(w[3] > w[2] for w in wanted)


def test_trimmed_cache_answers_the_same():
    texts = random_texts(11, 800)
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    large, small = alignment.Aligned.of(*paths), alignment.Aligned.of(*paths, entries=60)
    number, first = large.read(pa.array(texts))
    wanted = [b";".join(large.text[n] for n in number[a:b]) for a, b in zip(first, first[1:])]
    counts, again = alignment.Counts(large.words), alignment.Counts(large.words)
    counts.add(large, number)
    got = []
    for at, part in pieces.parts_of(pa.array(texts), 300):
        small.trim()
        number, first = small.read(part)
        again.add(small, number)
        got += [b";".join(small.text[n] for n in number[a:b]) for a, b in zip(first, first[1:])]
    assert got == wanted
    assert np.array_equal(counts.vector, again.vector) and np.array_equal(counts.pairs, again.pairs) and np.array_equal(counts.n, again.n)
    assert counts.vector.sum() > 100 and counts.n.sum() > 100
