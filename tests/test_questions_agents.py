import json

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import agents, questions


def chat(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def pair(q, a):
    return {"Query": q, "Expected_Response": a}


ONE = [pair("q1", "a1")]
REPLIES = [
    # content, error kind, error, pairs
    (json.dumps(ONE), None, None, 1),
    (f"```json\n{json.dumps(ONE * 3)}\n```", None, None, 3),
    ("Here: []", "RUNTIME", None, 0),
    ("[]", "SCHEMA", "Model returned an empty array.", 0),
    (json.dumps(ONE + [5]), "SCHEMA", "Element at index 1 is not a JSON object.", 0),
    (json.dumps(ONE + [pair(" ", "a")]), "SCHEMA", "Element at index 1 is missing or has empty 'Query' field.", 0),
    (json.dumps([pair(None, "a")]), "SCHEMA", "Element at index 0 is missing or has empty 'Query' field.", 0),
    (json.dumps([{"Query": "q"}]), "SCHEMA", "Element at index 0 is missing or has empty 'Expected_Response' field.", 0),
    (json.dumps([pair(7, "a")]), "RUNTIME", "Element at index 0 has a 'Query' that is not a string.", 0),
    (json.dumps([pair("q", [1])]), "RUNTIME", "Element at index 0 has a 'Expected_Response' that is not a string.", 0),
    (json.dumps([pair(7, "a"), 5]), "SCHEMA", "Element at index 1 is not a JSON object.", 0),
    ("[1, ", "RUNTIME", None, 0),
]


@pytest.fixture(scope="module")
def checked(spark):
    frame = spark.createDataFrame([(i, 3, chat(r[0])) for i, r in enumerate(REPLIES)],
                                  "doc_id int, query_count int, body string").coalesce(1)
    return questions.check_questions(questions.parse_questions(frame))


def test_array_check(checked):
    for row in checked.collect():
        _, kind, error, _ = REPLIES[row.doc_id]
        assert (row.error_kind, row.array_error) == (kind, error), REPLIES[row.doc_id]


def test_first_hundred_characters_are_shown(spark):
    text = "no array " * 30
    frame = spark.createDataFrame([(chat(text),)], "body string")
    got = questions.parse_questions(frame).first()
    assert got.parse_error == "Expected JSON array starting with '[', got: " + text[:100]
    assert got.error_class == "BAD_JSON"


def test_rows_and_totals(checked):
    rows = questions.question_rows(checked).collect()
    assert sorted((r.doc_id, r.pos, r.query) for r in rows) == [(0, 0, "q1"), (1, 0, "q1"), (1, 1, "q1"), (1, 2, "q1")]
    totals = {r.doc_id: r for r in questions.question_totals(checked).collect()}
    assert (totals[0].total_generated, totals[0].count_matches) == (1, False)
    assert (totals[1].total_generated, totals[1].count_matches) == (3, True)
    assert totals[1].message == "PASS - Generated 3 query-response pairs."
    assert totals[3].message == "Error: Model returned an empty array." and totals[3].total_generated is None


# --- agent traces ---------------------------------------------------------------------

BOTH = ["search_order", "create_refund"]
DONE = "All of it went back successfully (ORD123)"


def call(name, order="ORD123"):
    return (name, {} if order is None else {"order_id": order})


TRACES = {
    "TC001": ([call(t) for t in BOTH], "ORD123", DONE, None),
    "m1": ([call("drop_table"), call("create_refund")], "ORD123", DONE, "tool_exists"),
    "m2": ([call("search_order", "ORD9"), call("create_refund")], "ORD123", DONE, "tool_params"),
    "m3": ([call("search_order", None), call("create_refund")], "ORD123", DONE, "tool_params"),
    "m4": ([call(t) for t in reversed(BOTH)], "ORD123", DONE, "tool_sequence"),
    "m5": ([call(t, "ORD999") for t in BOTH], "ORD999", DONE, "backend_exists"),
    "m6": ([call(t, "ORD999") for t in BOTH], "ORD999", "Working on it", "backend_exists"),
    "m7": ([], "ORD123", DONE, "tool_sequence"),
    "m8": ([call("search_order", "ORD9"), call("drop_table")], "ORD123", DONE, "tool_params"),
    "m9": ([call("drop_table", "ORD9")], "ORD123", DONE, "tool_exists"),
    "m10": ([call("Search_Order"), call("create_refund")], "ORD123", DONE, "tool_exists"),
    "m11": ([call("search_order", None)], None, DONE, "input"),
    "m12": ([call(None), call("create_refund")], "ORD123", DONE, "tool_exists"),
    "m13": ([*[call(t) for t in BOTH], call("check_policy")], "ORD123", DONE, "tool_sequence"),
}


@pytest.fixture(scope="module")
def traces(spark):
    cases = spark.createDataFrame(
        [(k, "Refund", BOTH, order) for k, (_, order, _, _) in TRACES.items()],
        "test_id string, input string, expected_tools array<string>, expected_order_id string")
    runs = spark.createDataFrame(
        [(k, calls, answer) for k, (calls, _, answer, _) in TRACES.items()],
        "test_id string, tool_calls array<struct<tool_name:string, arguments:map<string,string>>>, final_answer string")
    refunds = spark.createDataFrame([("ORD123",), ("ORD123",), (None,)], "order_id string")
    return cases, runs, refunds


def verdicts(frame):
    return {r.test_id: (r.status, r.failed_check, r.message) for r in frame.collect()}


def check(got):
    for key, (_, _, _, failed) in TRACES.items():
        wanted = "PASS" if failed is None else "REJECTED" if failed == "input" else "FAIL"
        assert got[key][:2] == (wanted, failed), key
    assert len(got) == len(TRACES)


def test_verdict(traces):
    got = verdicts(agents.agent_verdict(*traces))
    check(got)
    assert got["m1"][2] == "INVALID TOOL DETECTED -> drop_table"
    assert got["m3"][2] == "INVALID ORDER ID\nExpected -> ORD123\nActual -> null"
    assert got["m4"][2] == ("TOOL SEQUENCE MISMATCH\nExpected -> [search_order, create_refund]\n"
                            "Actual -> [create_refund, search_order]")


@pytest.mark.parametrize("more", [0, 2_000])
def test_catalogue_as_list_and_as_table(traces, spark, more):
    cases, runs, refunds = traces
    names = [*agents.TOOLS, *(f"tool{i}" for i in range(more))]
    tools = spark.createDataFrame([(t,) for t in [*names, None]], "tool_name string")
    check(verdicts(agents.agent_verdict(cases, runs, refunds, tools)))
    # Several runs of a case: each is judged by its own calls.
    twice = runs.unionByName(runs.select(
        "test_id", F.array(F.struct(F.lit("mystery").alias("tool_name"),
                                    F.create_map(F.lit("order_id"), F.lit("x")).alias("arguments"))).alias("tool_calls"),
        "final_answer"))
    by_list, by_table = (sorted(map(str, agents.with_unknown_tool(twice, t).collect())) for t in (names, tools))
    assert by_list == by_table and len(by_list) == 2 * len(TRACES)


def test_tools_from_a_table(traces, spark):
    cases, runs, refunds = traces
    tools = spark.createDataFrame([(t,) for t in [*agents.TOOLS, "drop_table"]], "tool_name string")
    got = verdicts(agents.agent_verdict(cases, runs, refunds, tools))
    assert got["m1"][1] == "tool_sequence"


def test_hallucination_and_backend(traces):
    cases, runs, refunds = traces
    flagged = agents.with_backend_flag(cases.join(runs, "test_id"), refunds)
    got = {r.test_id: (r.in_backend, r.h)
           for r in flagged.withColumn("h", agents.is_hallucination()).collect()}
    assert got["m5"] == (False, True) and got["m6"] == (False, False) and got["TC001"] == (True, False)
    assert got["m11"] == (False, True) and len(got) == len(TRACES)


def test_nulls_in_the_answer_are_no_claim(spark):
    frame = spark.createDataFrame([(None, False), ("SUCCESSFULLY", False)], "final_answer string, in_backend boolean")
    assert [r.h for r in frame.select(agents.is_hallucination().alias("h")).collect()] == [False, False]


def test_empty_call_list_passes_call_checks(spark):
    frame = spark.createDataFrame([("t", [], "ORD1", [])],
        "test_id string, tool_calls array<struct<tool_name:string, arguments:map<string,string>>>, "
        "expected_order_id string, expected_tools array<string>")
    got = agents.with_wrong_argument(agents.with_unknown_tool(frame)).withColumn("s", agents.same_sequence()).first()
    assert got.unknown_pos is None and got.wrong_pos is None and got.s is True


def test_id_argument(spark):
    frame = spark.sql("SELECT named_struct('tool_name','t','arguments',map('order_id','1')) AS c")
    assert frame.select(agents.id_argument(F.col("c")).alias("v")).first().v == "1"
