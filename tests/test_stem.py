import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.functions import stem
from gradeframe.functions.stem import porter_stem, stem_tokens
from gradeframe.operators import lexical

# Examples printed with the published algorithm, carried through all its steps.
EXAMPLES = """
caresses caress | ponies poni | ties ti | caress caress | cats cat | feed feed | agreed agre
plastered plaster | bled bled | motoring motor | sing sing | conflated conflat | troubled troubl
sized size | hopping hop | tanned tan | falling fall | hissing hiss | fizzed fizz | failing fail
filing file | happy happi | sky sky | relational relat | conditional condit | rational ration
valenci valenc | hesitanci hesit | digitizer digit | conformabli conform | radicalli radic
differentli differ | vileli vile | analogousli analog | vietnamization vietnam | predication predic
operator oper | feudalism feudal | decisiveness decis | hopefulness hope | callousness callous
formaliti formal | sensitiviti sensit | sensibiliti sensibl | triplicate triplic | formative form
formalize formal | electriciti electr | electrical electr | hopeful hope | goodness good
revival reviv | allowance allow | inference infer | airliner airlin | gyroscopic gyroscop
adjustable adjust | defensible defens | irritant irrit | replacement replac | adjustment adjust
dependent depend | adoption adopt | homologou homolog | communism commun | activate activ
angulariti angular | homologous homolog | effective effect | bowdlerize bowdler | probate probat
rate rate | cease ceas | controll control | roll roll | generalizations gener | oscillators oscil
"""
PAIRS = [tuple(p.split()) for line in EXAMPLES.strip().splitlines() for p in line.split("|")]


@pytest.mark.parametrize("word, stem", PAIRS)
def test_published_examples(word, stem):
    assert porter_stem(word) == stem


@pytest.mark.parametrize("word, stem", [
    ("by", "by"), ("is", "is"), ("123", "123"), ("", ""),      # short words and numbers stay
    ("possibly", "possibl"), ("archaeology", "archaeolog"),    # the author's later rules
    ("ing", "ing"), ("ied", "i"), ("yes", "ye"), ("eed", "eed"), ("syzygy", "syzygi"),
])
def test_edges(word, stem):
    assert porter_stem(word) == stem


def test_arrays_keep_order_repeats_nulls_and_empties(spark):
    rows = [(1, ["running", "runs", "running"]), (2, []), (3, None), (4, ["cats"])]
    frame = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1)
    got = {r.id: r.s for r in frame.select("id", stem_tokens("t").alias("s")).collect()}
    assert got == {1: ["run", "run", "run"], 2: [], 3: None, 4: ["cat"]}


def test_work_is_bounded_by_tokens(spark, monkeypatch):
    rows = [["running", "runs"] * 3, [], None, ["cats"] * 9, ["dogs", "cats"], ["ponies"], []]
    tokens = pa.array(rows[:1] + rows, pa.list_(pa.string())).slice(1)
    wanted = [r if r is None else [porter_stem(w) for w in r] for r in rows]
    monkeypatch.setattr(stem, "SLICE_TOKENS", 6)
    parts = list(stem._slices(tokens))
    assert parts == [(0, 3), (3, 4), (4, 7)]                     # a row with more tokens than the bound stands alone
    assert [len(p) for p in stem.stem_tokens.func(iter([tokens]))] == [3, 1, 3]
    assert [r for p in stem.stem_tokens.func(iter([tokens])) for r in p.to_pylist()] == wanted
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<string>").coalesce(1)
    assert [r.s for r in frame.select("id", stem_tokens("t").alias("s")).sort("id").collect()] == wanted


def test_squared_norms_of_stems(monkeypatch):
    rows = [(["runs", "running", "x", "cat"], ["run", "cats", "cat", "dog"]), ([], []), None, ([], ["ied", "ox"]), (["ox"] * 5, ["oxes"])]
    tokens = pa.array([r and r[0] + r[1] for r in rows], pa.list_(pa.string()))
    sizes = pa.array([r and len(r[0]) for r in rows], pa.int32())
    wanted = [(5, 6, 19), (0, 0, 0), (None, None, None), (0, 1, 1), (25, 1, 36)]  # run 2 1, cat 1 2, dog 0 1; "i" is too short
    for bound in (1, 4, 1 << 20):
        monkeypatch.setattr(stem, "SLICE_TOKENS", bound)
        got = [r for part in stem.stem_squares.func(iter([(tokens, sizes)])) for r in part.to_pylist()]
        assert [tuple(r.values()) for r in got] == wanted


def test_stemmed_cosine_does_not_fold_tokens_in_lambdas(spark):
    frame = spark.createDataFrame([("a cat", "a dog")], "expected string, actual string")
    plan = lexical.with_stemmed_cosine(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "aggregate(" not in plan


def test_order_of_tests(spark):
    # "being" is a stopword as written; "as" as a stem would be one, but is tested before stemming
    frame = spark.createDataFrame([("being asing its x tses",)], "text string")
    assert lexical.with_stemmed_tokens(frame, "text").first().tokens == ["as", "tse"]


def test_vocabulary_is_distinct(spark):
    frame = spark.createDataFrame([("cats cats dogs",), ("dogs",)], "text string")
    assert sorted(map(tuple, lexical.stem_vocabulary(frame, "text").collect())) == [("cats", "cat"), ("dogs", "dog")]


def test_one_python_stage_and_no_shuffle(spark):
    frame = spark.createDataFrame([("a cat", "a dog")], "expected string, actual string")
    scored = lexical.with_stemmed_cosine(frame).select(F.col("cosine"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_against_the_sql_stemmer():
    """The SQL twin marks vowels by patterns and shares only the suffix tables."""
    import random

    import duckdb
    import pyarrow as pa

    from gradeframe.functions.stem import STEP_2, STEP_3, STEP_4
    from gradeframe.plans.oracle import STEMS

    rng = random.Random(11)
    ends = [*STEP_2, *STEP_3, *STEP_4, "s", "ed", "ing", "y", "eed", "ies", "sses", "e", "ll", ""]
    words = {
        "".join(rng.choice("aeiouybcdlstzwxnr") for _ in range(rng.randint(0, 6)))
        + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "ly"])
        for _ in range(30_000)
    } - {""}
    connection = duckdb.connect()
    connection.register("tokens", pa.table({"term": sorted(words)}))
    stems = dict(connection.sql(f"WITH {STEMS} SELECT term, stem FROM stems").fetchall())
    assert {w: porter_stem(w) for w in words} == stems
