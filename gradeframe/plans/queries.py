"""One query per operator, each over whole tables and whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import files, http, text
from ..functions.stopwords import BASE
from ..operators import agents, attempts, lexical, questions, replies, requests, rules
from ..session import CHECKPOINT_KEY, shared_folder
from ..sources import schemas
from ..sources.files import with_document_text
from ..sources.schemas import conform
from ..sources.tables import once_delivered, read_replies, write_by_key, write_results
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

JUDGE_PROMPT = "Compare both answers."
QUESTION_PROMPT = "Write questions."
VISION_PROMPT = "Read the text in this picture."


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _score(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


# --- pairs and lexical scores ---------------------------------------------------------


@query
def pair_source(spark, folder):
    return fixtures.pairs(spark, folder).select("conv_id", "turn", "pair_id", "expected", "actual")


@query
def containment_terms(spark, folder):
    terms = {
        side: _joined(F.sort_array(text.keyword_terms(F.col(side), BASE))) for side in ("expected", "actual")
    }
    return fixtures.pairs(spark, folder).select(
        "pair_id", *[column.alias(f"{side}_terms") for side, column in terms.items()]
    )


@query
def containment(spark, folder):
    scored = lexical.with_containment(fixtures.pairs(spark, folder))
    return scored.select("conv_id", "turn", _score("containment_pct"))


@query
def containment_valid(spark, folder):
    scored = lexical.with_containment(fixtures.pairs(spark, folder))
    return scored.select("conv_id", "turn", _score("containment_pct"), "is_valid")


@query
def containment_documents(spark, folder):
    scored = lexical.with_containment(fixtures.document_pairs(spark, folder))
    return scored.select("doc_id", _score("containment_pct"), "is_valid")


def _kept(spark, folder, words):
    kept = text.without(text.keyword_tokens(F.col("text")), words)
    return fixtures.documents(spark, folder).select(
        "doc_id", F.size(kept).cast("bigint").alias("n_kept"), _joined(kept).alias("kept")
    )


@query
def stopword_filter(spark, folder):
    return _kept(spark, folder, BASE)


@query
def stopword_filter_ext(spark, folder):
    return _kept(spark, folder, fixtures.CALLER_WORDS)


@query
def clean_tokens(spark, folder):
    words = fixtures.CALLER_WORDS
    tokens = text.clean_tokens(F.col("text"), words)
    return fixtures.documents(spark, folder).select("doc_id", _joined(tokens).alias("tokens"))


def _percent(scored, *keys):
    return scored.select(*keys, F.round(F.col("cosine") * 100, 6).alias("cosine_pct"))


@query
def cosine_pct(spark, folder):
    return _percent(lexical.with_cosine(fixtures.pairs(spark, folder), fixtures.CALLER_WORDS), "pair_id")


@query
def cosine_pct_documents(spark, folder):
    return _percent(lexical.with_cosine(fixtures.document_pairs(spark, folder), fixtures.CALLER_WORDS), "doc_id")


@query
def cosine_pct_table(spark, folder):
    """The list as a table: one constant array, no shuffle of the pairs."""
    words = fixtures.caller_stopwords(spark, folder)
    return _percent(lexical.with_cosine(fixtures.document_pairs(spark, folder), words), "doc_id")


@query
def cosine_by_terms(spark, folder):
    words = fixtures.caller_stopwords(spark, folder)
    scored = lexical.cosine_by_terms(fixtures.document_pairs(spark, folder), words, key="doc_id")
    return _percent(scored, "doc_id")


@query
def cosine_verdict(spark, folder):
    number = F.col("conv_id") + F.col("turn")
    requests_in = fixtures.pairs(spark, folder).select(
        "pair_id",
        F.when(number % 9 != 0, F.col("expected")).alias("expected"),
        "actual",
        F.when(number % 7 != 0, (number % 10) * F.lit(10.0)).alias("threshold"),
    )
    verdict = lexical.with_cosine_verdict(
        conform(requests_in, schemas.LEXICAL_REQUEST), fixtures.CALLER_WORDS
    )
    return verdict.select("pair_id", _score("cosine_pct"), "threshold", "status", "message")


@query
def stem_terms(spark, folder):
    return lexical.stem_vocabulary(fixtures.documents(spark, folder), "text")


@query
def stemmed_tokens(spark, folder):
    stemmed = lexical.with_stemmed_tokens(fixtures.documents(spark, folder), "text")
    return stemmed.select("doc_id", _joined(F.col("tokens")).alias("tokens"))


@query
def cosine_stemmed(spark, folder):
    scored = lexical.with_stemmed_cosine(fixtures.pairs(spark, folder))
    return scored.select("pair_id", _score("cosine"))


@query
def cosine_stemmed_documents(spark, folder):
    scored = lexical.with_stemmed_cosine(fixtures.document_pairs(spark, folder))
    return scored.select("doc_id", _score("cosine"))


# --- input rules ----------------------------------------------------------------------


def _judge_inputs(spark, folder):
    typed = conform(fixtures.judge_inputs(spark, folder), schemas.JUDGE_REQUEST)
    return rules.with_input_error(typed, rules.judge_input_error())


@query
def judge_input_rules(spark, folder):
    return _judge_inputs(spark, folder).select("pair_id", "threshold", "input_error", "error_kind")


@query
def qa_input_rules(spark, folder):
    typed = conform(fixtures.question_inputs(spark, folder), schemas.QUESTION_REQUEST)
    checked = rules.with_input_error(typed, rules.question_input_error())
    return checked.select("doc_id", "query_count", "input_error", "error_kind")


# --- requests -------------------------------------------------------------------------


@query
def judge_prompt(spark, folder):
    prompt = requests.judge_prompt(F.lit(JUDGE_PROMPT), F.col("expected"), F.col("actual"))
    return fixtures.pairs(spark, folder).select("pair_id", prompt.alias("prompt"))


@query
def judge_prompt_b(spark, folder):
    prompt = requests.compare_prompt(F.col("expected"), F.col("actual"))
    return fixtures.pairs(spark, folder).select(
        "pair_id", prompt.alias("prompt"), F.lit(requests.PROMPT_VERSION).alias("prompt_version")
    )


@query
def judge_request(spark, folder):
    asked = fixtures.pairs(spark, folder).withColumn("prompt", F.lit(JUDGE_PROMPT))
    return requests.with_judge_request(asked).select("pair_id", "body")


@query
def judge_request_b(spark, folder):
    models = F.array(*[F.lit(m) for m in attempts.JUDGE_CHAIN])
    asked = fixtures.pairs(spark, folder).withColumn("model", F.explode(models))
    return requests.with_compare_request(asked).select("pair_id", "model", "prompt_version", "body")


@query
def judge_request_direct(spark, folder):
    models = F.array(*[F.lit(m) for m in attempts.JUDGE_CHAIN])
    asked = fixtures.pairs(spark, folder).withColumn("model", F.explode(models))
    sent = requests.with_compare_request(asked, requests.DIRECT_TEMPERATURE_MODELS)
    return sent.select("pair_id", "model", "body")


@query
def vision_request(spark, folder):
    asked = fixtures.images(spark, folder).withColumns(
        {"model": F.lit(attempts.VISION_CHAIN[0]), "prompt": F.lit(VISION_PROMPT)}
    )
    return requests.with_vision_request(asked).select("doc_id", "body")


@query
def qa_prompt(spark, folder):
    count = (F.col("doc_id") % 50 + 1).alias("query_count")
    prompt = requests.question_prompt(F.lit(QUESTION_PROMPT), F.col("text"), count)
    return fixtures.documents(spark, folder).select("doc_id", prompt.alias("prompt"))


@query
def qa_request(spark, folder):
    asked = fixtures.documents(spark, folder).withColumns(
        {"prompt": F.lit(QUESTION_PROMPT), "query_count": F.col("doc_id") % 50 + 1}
    )
    return requests.with_question_request(asked).select("doc_id", "body")


# --- replies --------------------------------------------------------------------------


@query
def parse_chat(spark, folder):
    parsed = replies.parse_chat(fixtures.chat_replies(spark, folder))
    return parsed.select("doc_id", "content", "parse_error", "error_class")


@query
def parse_responses(spark, folder):
    parsed = replies.parse_responses(fixtures.responses_replies(spark, folder))
    return parsed.select("doc_id", "content", "parse_error", "error_class")


@query
def fence_strip(spark, folder):
    fenced = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))
    ).otherwise(F.col("text"))
    stripped = text.strip_fence(text.trim_control(fenced))
    return fixtures.documents(spark, folder).select("doc_id", stripped.alias("stripped"))


def _judged(spark, folder, mode="checked"):
    return replies.check_judge_schema(replies.parse_chat(fixtures.chat_replies(spark, folder)), mode=mode)


@query
def judge_schema(spark, folder):
    return _judged(spark, folder).select("doc_id", "parse_error", "schema_error", "error_class")


@query
def judge_schema_unchecked(spark, folder):
    return _judged(spark, folder, "unchecked").select("doc_id", "schema_error", "judge_score")


@query
def judge_scores(spark, folder):
    return _judged(spark, folder).select("doc_id", "judge_score", "reason")


@query
def reason_lines(spark, folder):
    lines = text.reason_lines(F.concat("text", F.lit("\n\n")))
    return fixtures.documents(spark, folder).select("doc_id", F.posexplode(lines).alias("pos", "line"))


def _judge_sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Requests with their thresholds, and the scores of their replies."""
    judged = _judged(spark, folder).select(
        F.col("doc_id").cast("string").alias("pair_id"), "judge_score", "reason"
    )
    return _judge_inputs(spark, folder), judged


def _verdict_columns(verdict: DataFrame) -> DataFrame:
    return verdict.select(
        "pair_id", "judge_score", "threshold", F.size("reason_lines").cast("bigint").alias("n_lines"),
        "status", "error_kind", "message",
    )


@query
def judge_verdict(spark, folder):
    """Requests joined with their replies: the thresholds come from the first, the scores from the second."""
    return _verdict_columns(replies.judge_pairs(*_judge_sides(spark, folder)))


@query
def judge_verdict_by_key(spark, folder):
    """The same over two tables that lie by key, as a service that judges again and again would keep them."""
    buckets, run = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    sides = [
        write_by_key(side, f"{name}_{run}", buckets, path=_folder(spark, name))
        for name, side in zip(("requests", "judged"), _judge_sides(spark, folder))
    ]
    return _verdict_columns(replies.judge_pairs(*sides))


# --- attempts -------------------------------------------------------------------------


def _outcomes(spark, folder, client="judge"):
    """The log with outcomes as each client sees them.

    The direct client neither strips fences nor checks the schema; the image
    reader takes the text as it is.
    """
    log = replies.parse_responses(fixtures.attempts(spark, folder), fence=client == "judge")
    if client != "vision":
        log = replies.check_judge_schema(log, mode="unchecked" if client == "direct" else "checked")
    return attempts.with_outcome(log)


@query
def http_outcome(spark, folder):
    log = fixtures.attempts(spark, folder)
    outcome = http.http_outcome(F.col("http_status"))
    return log.select("pair_id", "model", "attempt_no", outcome.alias("outcome"))


def _waits(log, policy):
    timed = attempts.with_wait(log, policy)
    return timed.select("pair_id", "model", "attempt_no", "outcome", "wait_ms")


@query
def attempt_wait(spark, folder):
    return _waits(_outcomes(spark, folder), "responses")


@query
def attempt_wait_direct(spark, folder):
    return _waits(_outcomes(spark, folder, "direct"), "direct")


@query
def model_order(spark, folder):
    order = attempts.model_order(F.coalesce("preferred_model", F.lit(attempts.JUDGE_CHAIN[0])))
    return fixtures.preferred_models(spark, folder).select(
        "pair_id", "preferred_model", F.posexplode(order).alias("rank", "model")
    )


def _one_model(log):
    return log.withColumn("preferred_model", F.lit(None).cast("string"))


@query
def resolve_attempts(spark, folder):
    return attempts.resolve_attempts(_outcomes(spark, folder), "responses", attempts.JUDGE_CHAIN)


@query
def resolve_attempts_chat(spark, folder):
    log = _one_model(_outcomes(spark, folder))
    return attempts.resolve_attempts(log, "chat", attempts.JUDGE_CHAIN[:1])


@query
def resolve_attempts_direct(spark, folder):
    log = _one_model(_outcomes(spark, folder, "direct"))
    return attempts.resolve_attempts(log, "direct", attempts.JUDGE_CHAIN[:1])


@query
def resolve_attempts_vision(spark, folder):
    log = _outcomes(spark, folder, "vision")
    return attempts.resolve_attempts(log, "vision", attempts.VISION_CHAIN, payload=("content",))


# --- documents, generated pairs, pictures ---------------------------------------------


@query
def document_source(spark, folder):
    """The table's texts as bytes; files come by `read_files` in the same columns."""
    content = F.col("content")
    return fixtures.document_bytes(spark, folder).select(
        "doc_id", F.octet_length(content).cast("bigint").alias("length"), F.hex(F.substring(content, 1, 4)).alias("first_bytes")
    )


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks share; on one machine without a named one, a temporary folder."""
    if spark.conf.get(CHECKPOINT_KEY, None) is None and spark.sparkContext.master.startswith("local"):
        return f"{tempfile.mkdtemp(prefix='tables-')}/{name}"
    return shared_folder(spark, f"tables/{name}-{uuid.uuid4().hex}")


@query
def reply_source(spark, folder):
    """Replies as the outside service leaves them: written, and read again with the declared schema."""
    path = _folder(spark, "replies")
    conform(fixtures.attempts(spark, folder), schemas.REPLIES).write.parquet(path)
    return once_delivered(read_replies(spark, path), "received_at").select(
        "pair_id", "model", "attempt_no", "http_status", "retry_after", "body")


@query
def result_sink(spark, folder):
    """Verdicts written by status, and read again."""
    path = _folder(spark, "results")
    write_results(cosine_verdict(spark, folder), path)
    return spark.read.parquet(path).select("pair_id", "cosine_pct", "threshold", "status", "message")


@query
def document_type(spark, folder):
    kind = files.document_type(F.col("content"))
    return fixtures.document_bytes(spark, folder).select("doc_id", kind.alias("doc_type"))


@query
def document_text(spark, folder):
    read = with_document_text(fixtures.document_bytes(spark, folder))
    return read.select("doc_id", "doc_type", "text", "document_error")


@query
def qa_parse(spark, folder):
    parsed = questions.parse_questions(fixtures.question_replies(spark, folder))
    return parsed.select("doc_id", F.size("elements").cast("bigint").alias("n_elements"), "parse_error", "error_class")


def _checked_questions(spark, folder):
    return questions.check_questions(questions.parse_questions(fixtures.question_replies(spark, folder)))


@query
def qa_validate(spark, folder):
    return _checked_questions(spark, folder).select("doc_id", "array_error", "error_kind")


@query
def qa_pairs(spark, folder):
    return questions.question_rows(_checked_questions(spark, folder))


@query
def qa_totals(spark, folder):
    return questions.question_totals(_checked_questions(spark, folder))


@query
def media_type(spark, folder):
    return fixtures.images(spark, folder).select(
        "doc_id", "path", files.media_type(F.col("path")).alias("media_type")
    )


@query
def data_url(spark, folder):
    url = files.data_url(files.media_type(F.col("path")), F.col("content"))
    return fixtures.images(spark, folder).select("doc_id", url.alias("data_url"))


# --- agent traces ---------------------------------------------------------------------


@query
def tool_exists(spark, folder):
    checked = agents.with_unknown_tool(fixtures.runs(spark, folder))
    return checked.select(
        "test_id", F.col("unknown_pos").isNull().alias("all_known"), "unknown_pos", "unknown_tool"
    )


@query
def tool_exists_table(spark, folder):
    """The catalogue as a table: the tools that cases expect."""
    tools = fixtures.cases(spark, folder).select(F.explode("expected_tools").alias("tool_name")).distinct()
    checked = agents.with_unknown_tool(fixtures.runs(spark, folder), tools)
    return checked.select(
        "test_id", F.col("unknown_pos").isNull().alias("all_known"), "unknown_pos", "unknown_tool"
    )


def _traces(spark, folder):
    return fixtures.cases(spark, folder).join(fixtures.runs(spark, folder), "test_id")


@query
def tool_params(spark, folder):
    """A case without an expected id is a reject: a null would equal a missing argument."""
    checked = agents.with_wrong_argument(_traces(spark, folder))
    rejected = F.col("expected_order_id").isNull()
    return checked.select(
        "test_id", rejected.alias("rejected"), F.when(~rejected, F.col("wrong_pos").isNull()).alias("all_right"),
        F.when(~rejected, F.col("wrong_pos")).alias("wrong_pos"),
    )


@query
def tool_sequence(spark, folder):
    return _traces(spark, folder).select(
        "test_id",
        F.array_join(agents.tool_names(F.col("tool_calls")), ",").alias("called"),
        agents.same_sequence().alias("same_sequence"),
    )


@query
def backend_exists(spark, folder):
    flagged = agents.with_backend_flag(fixtures.cases(spark, folder), fixtures.refunds(spark, folder))
    return flagged.select("test_id", "expected_order_id", "in_backend")


@query
def hallucination(spark, folder):
    flagged = agents.with_backend_flag(_traces(spark, folder), fixtures.refunds(spark, folder))
    return flagged.select("test_id", "in_backend", agents.is_hallucination().alias("is_hallucination"))


@query
def agent_verdict(spark, folder):
    return agents.agent_verdict(
        fixtures.cases(spark, folder), fixtures.runs(spark, folder), fixtures.refunds(spark, folder)
    )
