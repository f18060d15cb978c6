"""Input tables derived from the given ones, row by row, so that they grow with them.

Attempt logs, replies and traces are not among the given tables. Each is built
here from the columns of one table by fixed rules that SQL can repeat; no rule
gathers rows of a key, filters by a remainder or cuts a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stopwords import BASE
from ..operators.attempts import JUDGE_CHAIN
from ..operators.requests import ANSWER_FIELD, QUERY_FIELD, REASON_FIELD, SCORE_FIELD
from ..sources.pairs import neighbour_pairs, turn_pairs

CUSTOM_MODEL = "custom-model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return turn_pairs(table(spark, folder, "conversations"))


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(documents(spark, folder))


def _cases(number: Column, values: dict[int, Column], other: Column) -> Column:
    chosen = F
    for n, value in values.items():
        chosen = chosen.when(number == n, value)
    return chosen.otherwise(other)


# A caller's list: the base list and words of their own.
CALLER_WORDS = [*BASE, "also", "ed", "el", "en", "he", "however", "la", "le", "need", "nd", "or", "please", "que", "th", "the", "und"]


def caller_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's table of words: all words of up to three letters of the benchmark items."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, folder, "benchmark").select(F.explode(words).alias("word")).where("length(word) <= 3").distinct()


def judge_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with every kind of broken input; the threshold is still text."""
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    return documents(spark, folder).select(
        n.alias("pair_id"),
        _cases(n % 11, {0: none, 1: F.lit(" \t\n")}, F.col("text")).alias("expected"),
        _cases(n % 13, {0: F.lit("")}, F.col("source")).alias("actual"),
        _cases(n % 17, {0: F.lit(" ")}, F.lit("Compare both answers.")).alias("prompt"),
        _cases(n % 19, {0: none, 1: F.lit("abc")}, (n % 104 - 2).cast("string")).alias("threshold"),
    )


def question_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Document bytes of several kinds with pair counts in and out of range."""
    n = F.col("doc_id")
    counts = _cases(n % 17, {0: F.lit(None).cast("bigint"), 1: F.lit(50).cast("bigint")}, n % 53)
    return document_bytes(spark, folder).select(
        "doc_id", "content",
        counts.cast("int").alias("query_count"),
        _cases(n % 23, {0: F.lit("\n")}, F.lit("Write questions.")).alias("prompt"),
    )


def document_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bytes: PDF and ZIP signatures, blank, empty and plain ones."""
    kinds = {
        0: F.concat(F.lit("%PDF-1.7 "), "text"),
        1: F.concat(F.lit("PK\x03\x04"), "text"),
        2: F.lit("  \n"),
        3: F.lit(""),
    }
    text = _cases(F.col("doc_id") % 7, kinds, F.concat(F.lit(" \n"), "text", F.lit("\n ")))
    return documents(spark, folder).select("doc_id", F.encode(text, "UTF-8").alias("content"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """File names of several kinds; the document's bytes stand for the picture."""
    endings = {0: ".png", 1: ".PNG", 2: ".gif", 3: ".webp", 4: ".jpg"}
    ending = _cases(F.col("doc_id") % 6, {k: F.lit(v) for k, v in endings.items()}, F.lit(""))
    return documents(spark, folder).select(
        "doc_id",
        F.concat(F.lit("images/"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


def quoted(text: Column) -> Column:
    """The text as a JSON string with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("r"))), r'(?s)^\{"r":(.*)\}$', 1)


def _judge_json(score: Column, reason: Column, more: str = "") -> Column:
    return F.concat(
        F.lit(f'{{"{SCORE_FIELD}": '), score, F.lit(f', "{REASON_FIELD}": '), reason, F.lit(more + "}")
    )


def _chat_envelope(content: Column) -> Column:
    return F.concat(
        F.lit('{"choices":[{"index":0,"message":{"role":"assistant","content":'), quoted(content), F.lit("}}]}")
    )


def chat_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One chat reply per document, its whole text as the reason, in 18 forms."""
    n = F.col("doc_id")
    score, reason = (n % 101).cast("string"), quoted(F.col("text"))
    good = _judge_json(score, reason)
    contents = {
        1: F.concat(F.lit("```json\n"), good, F.lit("\n```")),
        2: _judge_json(F.concat(score, F.lit(".9")), reason),
        3: _judge_json(F.lit("-0.5"), reason),
        4: _judge_json(F.lit('"85"'), reason),
        5: _judge_json(F.lit("null"), reason),
        6: _judge_json(F.lit("101"), reason),
        7: F.concat(F.lit(f'{{"{SCORE_FIELD}": '), score, F.lit("}")),
        8: _judge_json(score, F.lit('"  "')),
        9: F.lit("oops"),
        10: _judge_json(score, reason, ', "Extra": 1'),
        11: F.lit(" \n"),
        15: F.concat(F.lit(f'{{"{REASON_FIELD}": '), reason, F.lit("}")),
        16: _judge_json(F.lit("true"), reason),
    }
    bodies = {
        12: F.lit('{"id": 1}'),
        13: F.lit('{"choices":[{"index":0}]}'),
        14: F.lit("not json"),
        17: F.lit('{"choices":[]}'),
    }
    form = n % 18
    body = _cases(form, bodies, _chat_envelope(_cases(form, contents, good)))
    return documents(spark, folder).select("doc_id", body.alias("body"))


def responses_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One reply per document in the responses envelope, in 14 forms."""
    n = F.col("doc_id")
    inner = _judge_json((n % 101).cast("string"), quoted(F.col("text")))
    fenced = F.concat(F.lit(" ```json\n"), inner, F.lit("\n``` "))

    def block(text: Column) -> Column:
        return F.concat(F.lit('{"type":"output_text","text":'), quoted(text), F.lit("}"))

    refusal = F.lit('{"type":"refusal","refusal":"no"}')

    def item(*blocks: Column, kind: str = "message") -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","content":['), F.concat_ws(",", *blocks), F.lit("]}"))

    def body(*items: Column) -> Column:
        return F.concat(F.lit('{"output":['), F.concat_ws(",", *items), F.lit("]}"))

    bodies = {
        1: body(item(refusal, block(inner))),
        2: body(item(refusal), item(block(inner))),
        3: body(item(block(fenced))),
        4: F.lit('{"id":"x"}'),
        5: F.lit('{"output":[]}'),
        6: body(F.lit('{"type":"message"}')),
        7: body(item(F.lit('{"type":"output_text"}'))),
        8: F.lit("not json"),
        9: body(item(block(inner), kind="reasoning")),
        10: body(F.lit('{"type":"message","content":null}'), item(block(inner), block(F.lit("later")))),
        11: F.lit('{"output":"x"}'),
        12: body(F.lit("7"), item(block(inner))),
        13: body(item(F.lit("null"), block(inner))),
    }
    good = body(F.lit('{"type":"reasoning"}'), item(block(inner)))
    return documents(spark, folder).select("doc_id", _cases(n % 14, bodies, good).alias("body"))


def preferred_models(spark: SparkSession, folder: str) -> DataFrame:
    """The model each document's judge is asked to start with; null for the default."""
    named = {i + 1: F.lit(m) for i, m in enumerate(JUDGE_CHAIN)}
    preferred = _cases(
        F.col("doc_id") % 5, {0: F.lit(None).cast("string"), **named}, F.lit(CUSTOM_MODEL)
    )
    return documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("pair_id"), "doc_id", "source",
        preferred.alias("preferred_model"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt log: up to five attempts on each of four models for every document.

    For some documents the log breaks off after two attempts per model.
    """
    models = F.array(*[F.lit(m) for m in [*JUDGE_CHAIN, CUSTOM_MODEL]])
    logged = F.when(F.expr("doc_id div 7") % 4 == 0, 2).otherwise(5)
    rows = (
        preferred_models(spark, folder)
        .select("*", F.posexplode(models).alias("_m", "model"))
        .withColumn("attempt_no", F.explode(F.sequence(F.lit(1), logged)))
        .withColumn(
            "_mix",
            (F.col("doc_id") * 7 + F.col("_m") * 5 + F.col("attempt_no") * 2 + F.expr("doc_id div 16")) % 23,
        )
    )
    mix = F.col("_mix")
    reason = quoted(F.concat(F.lit("try "), F.col("attempt_no").cast("string"), F.lit(" of "), "source"))
    score = (F.col("doc_id") % 101).cast("string")
    contents = {
        17: _judge_json(F.lit("101"), reason),
        18: F.lit("oops"),
        21: F.concat(F.lit("```json\n"), _judge_json(score, reason), F.lit("\n```")),
    }
    content = _cases(mix, contents, _judge_json(score, reason))
    body = F.when(mix == 19, '{"output":[]}').otherwise(
        F.concat(
            F.lit('{"output":[{"type":"message","content":[{"type":"output_text","text":'),
            quoted(content), F.lit("}]}]}"),
        )
    )
    status = (
        F.when(mix < 6, 429).when(mix < 11, 500).when(mix == 11, F.lit(None)).when(mix < 14, 404).otherwise(200)
    )
    waits = {0: F.lit("2"), 2: F.lit("abc"), 3: F.lit("45"), 4: F.lit(" 7 "), 5: F.lit("-1")}
    return rows.select(
        "pair_id", "doc_id", "preferred_model", "model", "attempt_no",
        status.cast("int").alias("http_status"),
        _cases(mix, waits, F.lit(None).cast("string")).alias("retry_after"),
        F.when(mix >= 14, body).alias("body"),
    )


def question_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One generation reply per document, with its whole text as the answers, in 12 forms."""
    n = F.col("doc_id")

    def one(query: Column, answer: Column = None) -> Column:
        fields = F.concat(F.lit(f'{{"{QUERY_FIELD}": '), query)
        if answer is not None:
            fields = F.concat(fields, F.lit(f', "{ANSWER_FIELD}": '), answer)
        return F.concat(fields, F.lit("}"))

    answer = quoted(F.col("text"))
    many = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), (n % 4 + 1).cast("int")),
                lambda i: one(F.concat(F.lit('"Question '), i.cast("string"), F.lit('?"')), answer),
            ),
            ", ",
        ),
        F.lit("]"),
    )
    first = one(F.lit('"First?"'), answer)

    def array(*elements: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(", ", *elements), F.lit("]"))

    contents = {
        4: F.concat(F.lit("```json\n"), many, F.lit("\n```")),
        5: F.concat(F.lit("Here: "), many),
        6: F.lit("[]"),
        7: array(first, F.lit("1")),
        8: array(first, one(F.lit('" "'), answer)),
        9: array(one(F.lit("7"), answer), first),
        10: array(first, one(F.lit('"Second?"'))),
        11: F.lit('[{"Query": '),
    }
    return documents(spark, folder).select(
        "doc_id",
        (n % 5 + 1).alias("query_count"),
        _chat_envelope(_cases(n % 12, contents, many)).alias("body"),
    )


def _order_id() -> Column:
    return F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string"))


def _expected_tools() -> Column:
    usual = F.array(F.lit("search_order"), F.lit("create_refund"))
    careful = F.array(F.lit("check_policy"), F.lit("search_order"), F.lit("create_refund"))
    return F.when(F.col("o_orderkey") % 3 == 1, careful).otherwise(usual)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """One test case per order."""
    missing = F.col("o_orderkey") % 29 == 0
    return table(spark, folder, "orders").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("test_id"),
        F.concat(F.lit("Please take back "), _order_id()).alias("input"),
        _expected_tools().alias("expected_tools"),
        F.when(~missing, _order_id()).alias("expected_order_id"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per order: right ones and eight kinds of wrong ones."""
    key, fault = F.col("o_orderkey"), F.col("o_orderkey") % 13
    tools = _expected_tools()
    other = F.array(F.lit("delete_order"))
    names = _cases(
        fault,
        {
            0: F.concat(other, tools),
            3: F.reverse(tools),
            4: F.slice(tools, 1, 0),
            5: F.concat(F.slice(tools, 1, 1), other),
            6: F.transform(tools, lambda t: F.initcap(t)),
            7: F.concat(tools, F.array(F.lit("check_policy"))),
        },
        tools,
    )

    def argument(position: Column) -> Column:
        wrong = (position == 0) & fault.isin(1, 5)
        return F.when(
            (position == 1) & (fault == 2), F.create_map(F.lit("note"), F.lit("none"))
        ).otherwise(F.create_map(F.lit("order_id"), F.when(wrong, "ORD0").otherwise(_order_id())))

    calls = F.transform(
        names, lambda name, i: F.struct(name.alias("tool_name"), argument(i).alias("arguments"))
    )
    answer = F.when(
        key % 4 < 3, F.concat(F.lit("The money was sent back successfully, see "), _order_id())
    ).otherwise("We still look into the matter.")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("T"), key.cast("string")).alias("test_id"),
        calls.alias("tool_calls"),
        answer.alias("final_answer"),
    )


def refunds(spark: SparkSession, folder: str) -> DataFrame:
    """Backend records: one row per returned line, so ids repeat."""
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return returned.select(F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string")).alias("order_id"))
