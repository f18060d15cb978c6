import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row, functions as F

from gradeframe.functions.stem import porter_stem
from gradeframe.functions.stopwords import BASE
from gradeframe.operators import lexical
from gradeframe.plans import fixtures
from gradeframe.sources.pairs import turn_pairs

FOLDER = "/root/testdata/sf0.001"
PAIRS = [
    ("ref3", "your parcel leaves the harbour by ship on a monday morning",
     "we only know that a parcel leaves by train every monday"),
    ("ref4", " ", " "),
    ("m1", "any text", ""),
    ("m2", "foo\nbar", "foo bar"),
    ("m3", "don't go", "dont go"),
    ("m4", "is refundable", "is not refundable"),
    ("m5", "café 123 5", "caf 123"),
    ("m6", "the same words", "the same words"),
    ("m7", None, "text"),
]
SCHEMA = "pair_id string, expected string, actual string"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, SCHEMA)


def by_id(frame, *columns):
    return {r.pair_id: tuple(r[c] for c in columns) for r in frame.collect()}


def test_containment(pairs):
    got = by_id(lexical.with_containment(pairs), "containment_pct", "is_valid")
    # parcel, leaves, monday of: know, parcel, leaves, train, every, monday
    assert got["ref3"] == (50.0, False)
    assert got["m1"] == (None, False)
    assert got["m2"] == (0.0, False)
    assert got["m3"] == (100.0, True)
    assert got["m4"] == (100.0, True)
    assert got["m6"] == (100.0, True)
    assert got["m7"] == (None, False)


def test_containment_threshold_is_strict(spark):
    rows = spark.createDataFrame([("p", "one two three", "one two three four five")], SCHEMA)
    assert by_id(lexical.with_containment(rows, []), "containment_pct", "is_valid")["p"] == (60.0, False)
    assert by_id(lexical.with_containment(rows, [], threshold=59.9), "is_valid")["p"] == (True,)


def test_cosine(pairs):
    got = by_id(lexical.with_cosine(pairs, BASE), "cosine")
    assert got["ref4"] == (1.0,)            # both empty, by our definition
    assert got["m1"] == (0.0,)
    assert got["m4"] == (1.0,)              # the negation is a stopword
    assert got["m6"] == (1.0,)
    assert got["m7"] == (None,)
    assert got["m5"][0] == pytest.approx(1.0)


def test_cosine_verdict(spark):
    rows = spark.createDataFrame(
        [("hit", "red car", "red car", 100.0), ("edge", "red car", "red bus", 50.0),
         ("miss", "red car", "red bus", 50.1), ("empty", " ", " ", 50.0),
         ("null", None, "x", 50.0), ("mark", "red", "red", None)],
        SCHEMA + ", threshold double",
    )
    got = by_id(lexical.with_cosine_verdict(rows, BASE), "cosine_pct", "status", "message")
    assert got["hit"] == (100.0, "PASS", "Similarity Matched | Score: 100.0")
    assert got["edge"] == (50.0, "PASS", "Similarity Matched | Score: 50.0")
    assert got["miss"] == (50.0, "FAIL", "Not Matched | Score: 50.0")
    assert got["empty"][:2] == (100.0, "PASS")
    assert got["null"] == (None, "FAIL", "Error: text is null")
    assert got["mark"] == (None, "FAIL", "Error: threshold is null")


def brute_tokens(value, stop, stem=False):
    out = []
    for run in re.findall(r"[^\W\d_]+|\d+", value.lower()):
        token = re.sub("[^a-z0-9]", "", run)
        if token and token not in stop:
            token = porter_stem(token) if stem else token
            if len(token) > 1:
                out.append(token)
    return Counter(out)


def brute_cosine(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    dot = sum(a[t] * b[t] for t in a)
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


@pytest.fixture(scope="module")
def random_pairs(spark):
    rng = random.Random(7)
    words = "the of run running runs order orders ordered 12 7 café refund refunds policy x a1b".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))

    rows = [(str(i), sentence(), sentence()) for i in range(60)]
    rows.append(("long", " ".join(["order refund"] * 20_000), "order policy"))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stem", [False, True])
def test_cosine_against_brute_force(random_pairs, stem):
    rows, frame = random_pairs
    scored = (lexical.with_stemmed_cosine if stem else lexical.with_cosine)(frame, BASE)
    got = by_id(scored, "cosine")
    for key, expected, actual in rows:
        a, b = (brute_tokens(t, set(BASE), stem) for t in (expected, actual))
        assert got[key][0] == pytest.approx(brute_cosine(a, b), abs=1e-12), key


def test_term_form_equals_row_form(spark, random_pairs, pairs):
    words = spark.createDataFrame([(w,) for w in BASE], "word string")
    for frame in (random_pairs[1], pairs):
        assert by_id(lexical.cosine_by_terms(frame, words), "cosine") == by_id(lexical.with_cosine(frame, BASE), "cosine")


def test_terms_are_counted_in_the_row(spark):
    rows = [("p", "Red car, red bus 7 12", "bus red-cart car's car"), ("q", None, "a b"), ("r", "", "caf\u00e9 caf"), (None, "x", None)]
    got = lexical.counted_terms(spark.createDataFrame(rows, SCHEMA), "pair_id").collect()
    assert sorted(got, key=str) == sorted([
        ("p", "", 1, 1), ("p", "red", 2, 1), ("p", "car", 1, 2), ("p", "bus", 1, 1), ("p", "12", 1, 0), ("p", "cart", 0, 1),
        ("q", "", 0, 1), ("r", "", 1, 1), ("r", "caf", 0, 2), (None, "", 1, 0)], key=lambda r: str(lexical_row(r)))


def lexical_row(values):
    return Row(pair_id=values[0], term=values[1], e=values[2], a=values[3])


def test_only_rows_that_share_a_key_are_aggregated_by_term(spark):
    rows = [("p", "red car", "red bus"), ("p", "red", None), ("q", "red", "red car"), (None, "a b", "ox"), (None, "ox", "ox")]
    frame, words = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("the",)], "word string")
    scored = lexical.cosine_by_terms(frame, words)
    got = by_id(scored, "cosine")
    assert set(got) == {"p", "q", None} and got[None] == (1.0,)      # rows of one key count as one pair
    assert got["p"][0] == pytest.approx(2 / math.sqrt(5 * 2)) and got["q"][0] == pytest.approx(1 / math.sqrt(2))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"Aggregate \[pair_id#\d+, term#\d+\].*\n", plan)  # one such table, over few rows
    shared = re.compile(r"Filter \(_rows#\d+L > 1\)")
    assert shared.search(below) and not shared.search(above)


def test_cosine_is_symmetric_and_bounded(random_pairs):
    frame = random_pairs[1]
    swapped = frame.selectExpr("pair_id", "actual AS expected", "expected AS actual")
    forth, back = by_id(lexical.with_cosine(frame, BASE), "cosine"), by_id(lexical.with_cosine(swapped, BASE), "cosine")
    assert forth == back and all(0 <= v[0] <= 1 for v in forth.values())


def test_stopword_list_is_an_argument(spark):
    rows = spark.createDataFrame([("p", "is refundable", "is not refundable")], SCHEMA)
    kept = [w for w in BASE if w != "not"]
    assert by_id(lexical.with_cosine(rows, kept), "cosine")["p"][0] == pytest.approx(1 / math.sqrt(2))
    table = spark.createDataFrame([("is",)], "word string")
    assert by_id(lexical.cosine_by_terms(rows, table), "cosine")["p"][0] == pytest.approx(1 / math.sqrt(2))
    assert by_id(lexical.with_cosine(rows, table), "cosine")["p"][0] == pytest.approx(1 / math.sqrt(2))
    with pytest.raises(TypeError, match="joins"):  # a table is never read while a plan is built
        lexical.with_containment(rows, table)


@pytest.mark.parametrize("score, wanted", [
    (lambda p: lexical.with_containment(p).where("not is_valid"), ("regexp_replace", 2)),
    (lambda p: lexical.with_cosine(p, BASE).where("cosine < 0.5"), ("regexp_extract_all", 2)),
    (lambda p: lexical.with_cosine_verdict(p.withColumn("threshold", F.lit(50.0)), BASE).where("status = 'FAIL'"), ("regexp_extract_all", 2)),
    (lambda p: lexical.with_stemmed_cosine(p).where("cosine < 0.5"), ("regexp_extract_all", 2)),
])
def test_filter_on_a_score_does_not_tokenise_again(spark, score, wanted):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "a c")], "conv_id int, turn int, role string, text string")
    plan = score(turn_pairs(turns))._jdf.queryExecution().optimizedPlan().toString()
    pattern, times = wanted
    assert plan.count(pattern) == times and plan.count("ArrowEvalPython") <= 1
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "regexp" not in join


def test_a_table_of_stopwords_becomes_one_constant(spark):
    pairs = fixtures.document_pairs(spark, FOLDER)
    words = fixtures.caller_stopwords(spark, FOLDER)
    scored = lexical.with_cosine(pairs, words).select("doc_id", F.round("cosine", 9).alias("cosine"))
    wanted = lexical.cosine_by_terms(pairs, words, key="doc_id").select("doc_id", F.round("cosine", 9).alias("cosine"))
    assert sorted(map(str, scored.collect())) == sorted(map(str, wanted.collect()))
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet").selectExpr("text expected", "reverse(text) actual")
    plan = lexical.with_cosine(table, words)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "Join" not in plan.split("Subquery")[0]
    none = lexical.with_cosine(table.limit(5), words.where("false")).select("cosine").collect()
    assert none == lexical.with_cosine(table.limit(5), []).select("cosine").collect()
