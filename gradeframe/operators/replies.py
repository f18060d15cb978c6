"""Replies of a model: unwrap the envelope, check the inner JSON, decide.

Each step keeps the row and names what is wrong with it: ``parse_error`` is the
message, ``error_class`` one of ENVELOPE, BAD_JSON and SCHEMA, which the retry
policies read. Parsed values sit in their own projection, so a body is parsed
once however many tests look at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import reason_lines, strip_fence, strip_unicode, trim_control
from ..functions.variants import field, first_of, is_number, is_object, kind_of
from .requests import REASON_FIELD, SCORE_FIELD
from .staging import evaluate_once

# Fixed value: pass mark used when the row brings none.
JUDGE_THRESHOLD = 75

# Field, type, required; checked in this order.
JUDGE_SCHEMA = ((SCORE_FIELD, "INTEGER", True), (REASON_FIELD, "STRING", True))


def _problem(error_class: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(error_class).alias("error_class"), text.alias("parse_error"))


def _unwrapped(opened: DataFrame, problem: Column, content: Column, before: DataFrame) -> DataFrame:
    """Input columns with ``content``, ``parse_error`` and ``error_class``."""
    judged = opened.withColumn("_problem", problem)
    return evaluate_once(
        judged,
        drop=tuple(c for c in judged.columns if c not in before.columns),
        content=F.when(F.col("_problem").isNull(), content),
        parse_error=F.col("_problem.parse_error"),
        error_class=F.col("_problem.error_class"),
    )


def _envelope(replies: DataFrame, list_field: str) -> DataFrame:
    parsed = replies.withColumn("_envelope", F.try_parse_json("body"))
    return parsed.withColumn("_list", field(F.col("_envelope"), list_field, "array<variant>"))


def _not_an_object() -> Column:
    opens = F.coalesce(trim_control(F.col("body")).startswith("{"), F.lit(False))
    return F.when(F.col("_envelope").isNull() | ~opens, _problem("BAD_JSON", "Body is not a JSON object."))


def parse_chat(replies: DataFrame, fence: bool = True) -> DataFrame:
    """Adds ``content`` of ``choices[0].message`` of the JSON text in ``body``."""
    opened = (
        _envelope(replies, "choices")
        .withColumn("_first", F.get("_list", 0))
        .withColumn("_message", field(F.col("_first"), "message"))
        .withColumn("_first_kind", kind_of(F.col("_first")))
        .withColumn("_message_kind", kind_of(F.col("_message")))
        .withColumn("_text", trim_control(field(F.col("_message"), "content", "string")))
    )
    problem = first_of(
        _not_an_object(),
        F.when(
            F.coalesce(F.array_size("_list"), F.lit(0)) == 0,
            _problem("ENVELOPE", "Response missing 'choices' array."),
        ),
        F.when(~is_object(F.col("_first_kind")), _problem("BAD_JSON", "First choice is not a JSON object.")),
        F.when(~is_object(F.col("_message_kind")), _problem("ENVELOPE", "No 'message' object in first choice.")),
        F.when(
            F.coalesce(F.col("_text") == "", F.lit(True)),
            _problem("ENVELOPE", "Empty 'content' in assistant message."),
        ),
    )
    content = strip_fence(F.col("_text")) if fence else F.col("_text")
    return _unwrapped(opened, problem, content, replies)


def parse_responses(replies: DataFrame, fence: bool = True) -> DataFrame:
    """Adds ``content``: the first ``output_text`` block of the ``message`` items of ``output``."""

    def stops(items: Column) -> Column:
        """In order: ``output_text`` blocks of messages, and what is no object, which ends the search."""
        kind = "array<struct<bad: boolean, block: variant>>"
        no_object = lambda v: ~F.coalesce(is_object(kind_of(v)), F.lit(False))
        bad = F.array(F.struct(F.lit(True).alias("bad"), F.lit(None).cast("variant").alias("block")))

        def of_item(item: Column) -> Column:
            blocks = F.coalesce(field(item, "content", "array<variant>"), F.array().cast("array<variant>"))
            found = F.filter(
                F.transform(blocks, lambda b: F.struct(no_object(b).alias("bad"), b.alias("block"))),
                lambda s: s.bad | F.coalesce(field(s.block, "type", "string") == "output_text", F.lit(False)),
            )
            is_message = F.coalesce(field(item, "type", "string") == "message", F.lit(False))
            return F.when(no_object(item), bad).when(is_message, found).otherwise(F.array().cast(kind))

        return F.flatten(F.transform(items, of_item))

    opened = (
        _envelope(replies, "output")
        .withColumn("_stop", F.try_element_at(stops(F.col("_list")), F.lit(1)))
        .withColumn("_value", field(F.col("_stop.block"), "text"))
        .withColumn("_text", strip_unicode(F.try_variant_get("_value", "$", "string")))
    )
    problem = first_of(
        _not_an_object(),
        F.when(F.col("_list").isNull(), _problem("ENVELOPE", "Response missing 'output' array.")),
        F.when(F.col("_stop").isNull(), _problem("ENVELOPE", "No 'output_text' block found in response.")),
        F.when(F.col("_stop.bad"), _problem("BAD_JSON", "Item or block is not a JSON object.")),
        F.when(
            F.coalesce(kind_of(F.col("_value")) != "STRING", F.lit(True)),
            _problem("BAD_JSON", "Block has no 'text' string."),
        ),
    )
    content = strip_fence(F.col("_text"), strip_unicode) if fence else F.col("_text")
    return _unwrapped(opened, problem, content, replies)


# Names used in messages for the types a number was expected over.
_TYPE_NAMES = (("STRING", "String"), ("BOOLEAN", "Boolean"), ("VOID", "Null"), ("ARRAY", "JSONArray"))


def _type_name(kind: Column) -> Column:
    named = F.when(kind.startswith("OBJECT"), "JSONObject")
    for prefix, name in _TYPE_NAMES:
        named = named.when(kind.startswith(prefix), name)
    return named.otherwise(kind)


def _field_rule(index: int, name: str, kind: str, required: bool) -> list[Column]:
    """Messages of one schema rule over the columns prepared in `check_judge_schema`."""
    found = F.col(f"_kind{index}")
    rules = []
    if required:
        rules.append(F.when(found.isNull(), f'Required field missing: "{name}"'))
    if kind == "INTEGER":
        whole = F.col(f"_number{index}").try_cast("int")
        inside = F.coalesce(whole.between(0, 100), F.lit(False))
        shown = F.coalesce(whole.cast("string"), F.col(f"_text{index}"))
        rules.append(
            F.when(
                found.isNotNull() & ~is_number(found),
                F.concat(F.lit(f'Field "{name}" must be a number, got: '), _type_name(found)),
            )
        )
        rules.append(
            F.when(
                found.isNotNull() & ~inside,
                F.concat(F.lit(f'Field "{name}" must be 0-100, got: '), shown),
            )
        )
    else:
        blank = (found != "STRING") | (trim_control(F.col(f"_text{index}")) == "")
        rules.append(F.when(blank, f'Field "{name}" must be a non-empty string.'))
    return rules


def check_judge_schema(parsed: DataFrame, schema=JUDGE_SCHEMA, mode: str = "checked") -> DataFrame:
    """Adds ``schema_error``, ``judge_score`` and ``reason`` from ``content``.

    ``checked`` applies the schema; a decimal score passes and is cut to its whole
    part. ``unchecked`` only reads the two fields: a quoted whole number and any
    range get through, a field that cannot be read is BAD_JSON.
    """
    if mode not in ("checked", "unchecked"):
        raise ValueError("mode is 'checked' or 'unchecked'")
    table = parsed.withColumn("_reply", F.try_parse_json("content"))
    for i, (name, _, _) in enumerate(schema):
        table = table.withColumn(f"_value{i}", field(F.col("_reply"), name))
    for i in range(len(schema)):
        value = F.col(f"_value{i}")
        table = table.withColumns({
            f"_kind{i}": kind_of(value),
            f"_number{i}": F.try_variant_get(value, "$", "double"),
            f"_text{i}": F.try_variant_get(value, "$", "string"),
        })

    position = {name: i for i, (name, _, _) in enumerate(schema)}
    score_at, reason_at = position[SCORE_FIELD], position[REASON_FIELD]
    number = F.col(f"_number{score_at}").try_cast("int")
    not_json = F.col("_reply").isNull() | ~F.col("content").startswith("{")
    bad_json = F.when(not_json, _problem("BAD_JSON", "Reply is not a JSON object."))
    if mode == "checked":
        score = F.when(is_number(F.col(f"_kind{score_at}")), number)
        messages = [m for i, rule in enumerate(schema) for m in _field_rule(i, *rule)]
        error = first_of(*messages)
        broken = F.when(error.isNotNull(), _problem("SCHEMA", error))
    else:
        quoted = F.when(
            (F.col(f"_kind{score_at}") == "STRING") & F.col(f"_text{score_at}").rlike(r"^[+-]?[0-9]+$"),
            F.col(f"_text{score_at}").try_cast("int"),
        )
        score = F.when(is_number(F.col(f"_kind{score_at}")), number).otherwise(quoted)
        broken = first_of(
            F.when(score.isNull(), _problem("BAD_JSON", f'"{SCORE_FIELD}" is not an integer.')),
            F.when(
                F.coalesce(F.col(f"_kind{reason_at}") != "STRING", F.lit(True)),
                _problem("BAD_JSON", f'"{REASON_FIELD}" is not a string.'),
            ),
        )

    fresh = F.when(F.col("parse_error").isNull(), first_of(bad_json, broken))
    judged = table.withColumn("_found", fresh)
    usable = F.col("parse_error").isNull() & F.col("_found").isNull()
    return evaluate_once(
        judged,
        drop=tuple(c for c in judged.columns if c not in parsed.columns),
        schema_error=F.col("_found.parse_error"),
        error_class=F.coalesce("error_class", F.col("_found.error_class")),
        judge_score=F.when(usable, score),
        reason=F.when(usable, F.col(f"_text{reason_at}")),
    )


def with_judge_verdict(judged: DataFrame) -> DataFrame:
    """Adds ``reason_lines``, ``status`` and ``message`` from ``judge_score`` and ``threshold``.

    A row without a score is a failed row; a null threshold means the default.
    """
    score = F.col("judge_score")
    mark = F.coalesce(F.col("threshold"), F.lit(JUDGE_THRESHOLD))
    passed = F.coalesce(score >= mark, F.lit(False))
    return judged.withColumns({
        "threshold": mark.cast("int"),
        "reason_lines": reason_lines(F.col("reason")),
        "status": F.when(passed, "PASS").otherwise("FAIL"),
        "message": F.when(score.isNull(), "Error: no valid reply")
        .when(passed, F.concat(F.lit("PASS - Similarity Score: "), score.cast("string"), F.lit("%")))
        .otherwise(
            F.concat(
                F.lit("FAIL - Similarity Score: "), score.cast("string"),
                F.lit("% is below threshold of "), mark.cast("string"), F.lit("%"),
            )
        ),
    })


def judge_pairs(requests: DataFrame, judged: DataFrame, key: str = "pair_id") -> DataFrame:
    """A verdict for every request: ``judge_score``, ``reason``, ``status``, ``error_kind``, ``message``.

    ``requests`` has ``threshold`` and ``input_error``, ``judged`` the score and reason by key. A rejected request
    fails as INPUT; one without a reply, or without a valid one, fails as RUNTIME.
    """
    answers = judged.select(key, "judge_score", "reason", F.lit(True).alias("_answered"))
    joined = requests.select(key, "threshold", "input_error").join(answers, key, "left")
    rejected = F.col("input_error").isNotNull()
    accepted = joined.withColumns({c: F.when(~rejected, F.col(c)) for c in ("judge_score", "reason")})
    verdict = with_judge_verdict(accepted.withColumn("_asked", F.col("threshold")))
    return verdict.select(
        key, "judge_score", "reason", "reason_lines",
        F.when(rejected, F.col("_asked")).otherwise(F.col("threshold")).alias("threshold"), "status",
        F.when(rejected, "INPUT").when(F.col("judge_score").isNull(), "RUNTIME").alias("error_kind"),
        F.when(rejected, F.concat(F.lit("Error: "), "input_error"))
        .when(F.col("_answered").isNull(), "Error: no reply").otherwise(F.col("message")).alias("message"),
    )
