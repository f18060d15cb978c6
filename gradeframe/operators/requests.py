"""Requests to an outside model as JSON text, one per row.

No call is made here: the rows are written for a batch service and its replies
come back as a table. The wording of the templates is an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.files import data_url, media_type

# Field names the replies must carry.
SCORE_FIELD = "Similarity Confidence Score"
REASON_FIELD = "Reason for Score"
QUERY_FIELD = "Query"
ANSWER_FIELD = "Expected_Response"

# Models that take a temperature, by client.
TEMPERATURE_MODELS = ("gpt-4.1", "gpt-4o", "gpt-4.1-mini", "gpt-4o-mini")
DIRECT_TEMPERATURE_MODELS = ("gpt-4.1", "gpt-4o", "gpt-4.1-mini")

PROMPT_VERSION = "v2"

JUDGE_SYSTEM = "You compare the meaning of two answers. Reply with valid JSON and nothing else."
JUDGE_RULES = (
    "These output rules replace any given above.\n"
    f'Reply with one JSON object holding "{SCORE_FIELD}" and "{REASON_FIELD}", without a code fence.\n'
    "The score is a whole number: 0 for an unrelated meaning, 100 for the same meaning.\n"
    "The reason is a text."
)
COMPARE_RULES = (
    "Compare the meaning of two sentences.\n"
    "- Shared wording or structure alone does not raise the score.\n"
    "- Different wording alone does not lower it; intent decides.\n"
    f'Reply with one JSON object: "{SCORE_FIELD}", a whole number from 0 to 100, and\n'
    f'"{REASON_FIELD}", naming similarities, differences, context, gaps and tone.'
)
QUESTION_SYSTEM = "You write question and answer pairs from a document. Reply with a JSON array and nothing else."
QUESTION_RULES = (
    "These output rules replace any given above.\n"
    f'Reply with a JSON array of objects holding "{QUERY_FIELD}" and "{ANSWER_FIELD}", without a code fence.\n'
    "Each answer must come from the document only. Number of objects: "
)


def judge_prompt(base: Column, expected: Column, actual: Column, rules: str = JUDGE_RULES) -> Column:
    """Caller's prompt, the pair, the output rules."""
    return F.concat(
        base,
        F.lit('\n\nExpected Response: "'), expected,
        F.lit('"\nActual Response:   "'), actual,
        F.lit('"\n\n' + rules),
    )


def compare_prompt(first: Column, second: Column, rules: str = COMPARE_RULES) -> Column:
    """Fixed rules and two sentences."""
    return F.concat(
        F.lit(rules + '\n\nSentence 1: "'), first, F.lit('"\nSentence 2: "'), second, F.lit('"')
    )


def question_prompt(base: Column, document: Column, count: Column, rules: str = QUESTION_RULES) -> Column:
    """Caller's prompt, the whole document, the output rules with the pair count."""
    return F.concat(
        base,
        F.lit("\n\nDOCUMENT CONTENT:\n"), document,
        F.lit("\n\n" + rules), count.cast("string"), F.lit("."),
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_body(system: str, prompt: Column, json_object: bool = True) -> Column:
    """Chat form: system and user message, temperature 0, optional JSON mode."""
    parts = [
        F.array(_message("system", F.lit(system)), _message("user", prompt)).alias("messages"),
        F.lit(0).alias("temperature"),
    ]
    if json_object:
        parts.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return F.to_json(F.struct(*parts))


def responses_body(
    model: Column, prompt: Column, temperature_models: Sequence[str] = TEMPERATURE_MODELS
) -> Column:
    """Responses form; the temperature is left out for models that refuse it."""
    return F.to_json(
        F.struct(
            model.alias("model"),
            prompt.alias("input"),
            F.when(model.isin(*temperature_models), F.lit(0)).alias("temperature"),
            F.struct(F.struct(F.lit("json_object").alias("type")).alias("format")).alias("text"),
        )
    )


def vision_body(model: Column, image_url: Column, prompt: Column) -> Column:
    """One user message with an image block and a text block."""
    none = F.lit(None).cast("string")
    image = F.struct(
        F.lit("input_image").alias("type"), image_url.alias("image_url"), none.alias("text")
    )
    words = F.struct(F.lit("input_text").alias("type"), none.alias("image_url"), prompt.alias("text"))
    user = F.struct(F.lit("user").alias("role"), F.array(image, words).alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(user).alias("input")))


def with_judge_request(pairs: DataFrame) -> DataFrame:
    """Adds ``body`` in the chat form from ``prompt``, ``expected`` and ``actual``."""
    prompt = judge_prompt(F.col("prompt"), F.col("expected"), F.col("actual"))
    return pairs.withColumn("body", chat_body(JUDGE_SYSTEM, prompt))


def with_compare_request(
    pairs: DataFrame, temperature_models: Sequence[str] = TEMPERATURE_MODELS
) -> DataFrame:
    """Adds ``body`` in the responses form and ``prompt_version``, for the row's ``model``."""
    prompt = compare_prompt(F.col("expected"), F.col("actual"))
    return pairs.withColumns({
        "body": responses_body(F.col("model"), prompt, temperature_models),
        "prompt_version": F.lit(PROMPT_VERSION),
    })


def with_question_request(documents: DataFrame) -> DataFrame:
    """Adds ``body`` from ``prompt``, ``text`` and ``query_count``."""
    prompt = question_prompt(F.col("prompt"), F.col("text"), F.col("query_count"))
    return documents.withColumn("body", chat_body(QUESTION_SYSTEM, prompt, json_object=False))


def with_vision_request(images: DataFrame) -> DataFrame:
    """Adds ``body`` from ``model``, ``path``, ``content`` (bytes) and ``prompt``."""
    url = data_url(media_type(F.col("path")), F.col("content"))
    return images.withColumn("body", vision_body(F.col("model"), url, F.col("prompt")))
