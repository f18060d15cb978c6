"""Generated question/answer pairs: array check and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_control
from ..functions.variants import field, first_of, is_object, kind_of
from .requests import ANSWER_FIELD, QUERY_FIELD
from .replies import _problem, parse_chat
from .staging import evaluate_once


def parse_questions(replies: DataFrame) -> DataFrame:
    """Adds ``elements`` (array of variant) from the chat envelope in ``body``."""
    parsed = parse_chat(replies).withColumn(
        "_elements", F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>")
    )
    start = F.concat(F.lit("Expected JSON array starting with '[', got: "), F.substring("content", 1, 100))
    fresh = F.when(
        F.col("parse_error").isNull(),
        first_of(
            F.when(~F.col("content").startswith("["), _problem("BAD_JSON", start)),
            F.when(F.col("_elements").isNull(), _problem("BAD_JSON", "Reply is not a JSON array.")),
        ),
    )
    usable = F.col("parse_error").isNull() & F.col("_found").isNull()
    return evaluate_once(
        parsed.withColumn("_found", fresh),
        drop=("_elements", "_found"),
        elements=F.when(usable, F.col("_elements")),
        parse_error=F.coalesce("parse_error", F.col("_found.parse_error")),
        error_class=F.coalesce("error_class", F.col("_found.error_class")),
    )


def _read(element: Column) -> Column:
    query, answer = field(element, QUERY_FIELD), field(element, ANSWER_FIELD)
    return F.struct(
        is_object(kind_of(element)).alias("is_object"),
        kind_of(query).alias("query_kind"),
        F.try_variant_get(query, "$", "string").alias("query"),
        kind_of(answer).alias("answer_kind"),
        F.try_variant_get(answer, "$", "string").alias("answer"),
    )


def _empty(kind: Column, text: Column) -> Column:
    return kind.isNull() | (kind == "VOID") | (trim_control(text) == "")


def _schema_message(item: Column, index: Column) -> Column:
    def message(words: str) -> Column:
        return F.concat(F.lit("Element at index "), index.cast("string"), F.lit(words))

    return (
        F.when(~item.is_object, message(" is not a JSON object."))
        .when(_empty(item.query_kind, item.query), message(" is missing or has empty 'Query' field."))
        .when(
            _empty(item.answer_kind, item.answer),
            message(" is missing or has empty 'Expected_Response' field."),
        )
    )


def _type_message(item: Column, index: Column) -> Column:
    def message(name: str) -> Column:
        return F.concat(
            F.lit("Element at index "), index.cast("string"), F.lit(f" has a '{name}' that is not a string.")
        )

    return F.when(item.query_kind != "STRING", message("Query")).when(
        item.answer_kind != "STRING", message("Expected_Response")
    )


def _first_message(items: Column, rule) -> Column:
    found = F.filter(F.transform(items, rule), lambda m: m.isNotNull())
    return F.try_element_at(found, F.lit(1))


def check_questions(parsed: DataFrame) -> DataFrame:
    """Adds ``array_error``, ``error_kind`` and ``items``; one bad element rejects the whole reply.

    A field that is present but no string is found only after the array check, so
    it is reported last and as RUNTIME.
    """
    read = parsed.withColumn("_items", F.transform("elements", _read))
    empty = F.when(F.size("_items") == 0, "Model returned an empty array.")
    checked = read.withColumns({
        "_schema": first_of(empty, _first_message(F.col("_items"), _schema_message)),
        "_type": _first_message(F.col("_items"), _type_message),
    })
    kind = (
        F.when(F.col("parse_error").isNotNull(), "RUNTIME")
        .when(F.col("_schema").isNotNull(), "SCHEMA")
        .when(F.col("_type").isNotNull(), "RUNTIME")
    )
    items = F.transform(
        "_items", lambda i: F.struct(i.query.alias("query"), i.answer.alias("expected_response"))
    )
    return evaluate_once(
        checked,
        drop=("_items", "_schema", "_type"),
        array_error=F.coalesce("_schema", "_type"),
        error_kind=kind,
        error_class=F.coalesce("error_class", F.when(F.col("_schema").isNotNull(), "SCHEMA")),
        items=F.when(kind.isNull(), items),
    )


def question_rows(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per generated pair: ``key``, ``pos`` (from 0), ``query``, ``expected_response``."""
    return checked.select(key, F.posexplode("items").alias("pos", "_item")).select(
        key, "pos", "_item.query", "_item.expected_response"
    )


def totals_by_status(totals: DataFrame) -> DataFrame:
    """Replies and generated pairs for each status, from `question_totals`; over a stream the state is one row each."""
    return totals.groupBy("status").agg(
        F.count(F.lit(1)).alias("replies"), F.coalesce(F.sum("total_generated"), F.lit(0)).alias("generated"),
        F.count_if("count_matches").alias("full_replies"))


def question_totals(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs per reply and whether that is the asked number; the size of the reply's own array.

    A reply that falls short is reported, not rejected.
    """
    total = F.when(F.col("error_kind").isNull(), F.size("items")).cast("bigint")
    passed = F.col("error_kind").isNull()
    return checked.select(
        key,
        total.alias("total_generated"),
        F.coalesce(total == F.col("query_count"), F.lit(False)).alias("count_matches"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        F.when(passed, F.concat(F.lit("PASS - Generated "), total.cast("string"), F.lit(" query-response pairs.")))
        .otherwise(F.concat(F.lit("Error: "), F.coalesce("parse_error", "array_error")))
        .alias("message"),
    )
