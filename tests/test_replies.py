import json

import pytest

from gradeframe.operators import replies
from gradeframe.sources.tables import write_by_key

S, R = "Similarity Confidence Score", "Reason for Score"


def chat(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def out(*items):
    return json.dumps({"output": list(items)})


def message(*blocks):
    return {"type": "message", "content": list(blocks)}


def block(text):
    return {"type": "output_text", "text": text}


GOOD = json.dumps({S: 80, R: "a\nb"})


def run(spark, parse, bodies):
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").coalesce(1)
    return sorted(parse(frame).collect(), key=lambda r: r.i)


def test_chat_envelope(spark):
    bodies = [
        chat(GOOD), chat("  \n" + GOOD + "\n"), chat(f"```json\n{GOOD}\n```"), chat(""), chat(None),
        '{"choices": []}', '{"choices": 5}', '{}', '{"choices": [{}]}', '{"choices": [{"message": 1}]}',
        '{"choices": [3]}', "[]", "nope", None,
    ]
    got = run(spark, replies.parse_chat, bodies)
    assert [r.content for r in got[:3]] == [GOOD] * 3
    assert [r.error_class for r in got] == (
        [None] * 3 + ["ENVELOPE"] * 7 + ["BAD_JSON"] * 4
    )
    assert got[3].parse_error == got[4].parse_error == "Empty 'content' in assistant message."
    assert got[8].parse_error == "No 'message' object in first choice."


def test_fence_is_optional(spark):
    fenced = f"```json\n{GOOD}\n```"
    got = run(spark, lambda f: replies.parse_chat(f, fence=False), [chat(fenced)])
    assert got[0].content == fenced


def test_responses_envelope(spark):
    bodies = [
        out({"type": "reasoning"}, message({"type": "refusal"}, block(GOOD), block("later"))),
        out(message(), message(block(" " + GOOD))),
        out({"type": "message", "content": None}, message(block(GOOD))),
        out({"type": "other", "content": [block(GOOD)]}), out(), "{}", '{"output": {}}',
        out(message({"type": "output_text"})), out(message({"type": "output_text", "text": 5})), "nope",
        out(7, message(block(GOOD))), out(message(None, block(GOOD))), out(message(block(GOOD)), 7), out({"type": "other", "content": [7]}, message(block(GOOD))),
    ]
    got = run(spark, replies.parse_responses, bodies)
    assert [r.content for r in got[:3]] == [GOOD] * 3
    assert [r.error_class for r in got[3:]] == ["ENVELOPE"] * 4 + ["BAD_JSON"] * 5 + [None] * 2  # what comes after the hit is not read


CASES = [
    # inner text, score, error or None
    (GOOD, 80, None),
    (json.dumps({S: 85.9, R: "x"}), 85, None),
    (json.dumps({S: -0.5, R: "x"}), 0, None),
    (json.dumps({S: 0, R: "x", "More": [1]}), 0, None),
    (json.dumps({S: "85", R: "x"}), None, f'Field "{S}" must be a number, got: String'),
    (json.dumps({S: None, R: "x"}), None, f'Field "{S}" must be a number, got: Null'),
    (json.dumps({S: True, R: "x"}), None, f'Field "{S}" must be a number, got: Boolean'),
    (json.dumps({S: [1], R: "x"}), None, f'Field "{S}" must be a number, got: JSONArray'),
    (json.dumps({S: {"a": 1}, R: "x"}), None, f'Field "{S}" must be a number, got: JSONObject'),
    (json.dumps({S: 101, R: "x"}), None, f'Field "{S}" must be 0-100, got: 101'),
    (json.dumps({S: -1, R: "x"}), None, f'Field "{S}" must be 0-100, got: -1'),
    (json.dumps({S: 10**30, R: "x"}), None, f'Field "{S}" must be 0-100, got: '),
    (json.dumps({R: "x"}), None, f'Required field missing: "{S}"'),
    (json.dumps({S: 1}), None, f'Required field missing: "{R}"'),
    (json.dumps({S: 1, R: "  "}), None, f'Field "{R}" must be a non-empty string.'),
    (json.dumps({S: 1, R: 7}), None, f'Field "{R}" must be a non-empty string.'),
    (json.dumps({S: 1, R: None}), None, f'Field "{R}" must be a non-empty string.'),
    ("oops", None, "Reply is not a JSON object."),
    ("[1]", None, "Reply is not a JSON object."),
]


def test_schema_checked(spark):
    got = run(spark, lambda f: replies.check_judge_schema(replies.parse_chat(f)), [chat(c[0]) for c in CASES])
    for row, (inner, score, error) in zip(got, CASES):
        assert row.judge_score == score, inner
        assert (row.schema_error or "").startswith(error or "") and (row.schema_error is None) == (error is None), inner
    assert got[0].reason == "a\nb" and got[4].reason is None
    assert got[4].error_class == "SCHEMA" and got[-1].error_class == "BAD_JSON"


def test_schema_unchecked(spark):
    inner = [
        {S: "85", R: "x"}, {S: 300, R: ""}, {S: "85.9", R: "x"}, {S: 1}, {S: None, R: "x"}, {S: 85.9, R: "x"},
        {S: " 5", R: "x"}, {S: True, R: "x"},
    ]
    got = run(spark, lambda f: replies.check_judge_schema(replies.parse_chat(f), mode="unchecked"),
              [chat(json.dumps(i)) for i in inner])
    assert [r.judge_score for r in got] == [85, 300, None, None, None, 85, None, None]
    assert {r.error_class for r in got if r.judge_score is None} == {"BAD_JSON"}
    with pytest.raises(ValueError):
        replies.check_judge_schema(spark.range(1), mode="loose")


def test_envelope_error_keeps_its_class(spark):
    got = run(spark, lambda f: replies.check_judge_schema(replies.parse_chat(f)), ["{}"])[0]
    assert got.error_class == "ENVELOPE" and got.schema_error is None and got.judge_score is None


def test_verdict(spark):
    frame = spark.createDataFrame(
        [(80, "a\nb\n", 80), (79, "x", 80), (75, "x", None), (None, None, 10)],
        "judge_score int, reason string, threshold int")
    got = replies.with_judge_verdict(frame).collect()
    assert [r.status for r in got] == ["PASS", "FAIL", "PASS", "FAIL"]
    assert got[0].message == "PASS - Similarity Score: 80%" and got[0].reason_lines == ["a", "b"]
    assert got[1].message == "FAIL - Similarity Score: 79% is below threshold of 80%"
    assert got[2].threshold == 75 and got[3].message == "Error: no valid reply"


def test_filter_on_a_parsed_column_does_not_copy_the_parse(spark):
    frame = spark.createDataFrame([(chat(GOOD),)], "body string")
    judged = replies.check_judge_schema(replies.parse_chat(frame)).where("error_class is null")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # envelope and reply


def test_tables_by_key_meet_without_a_shuffle(spark, tmp_path):
    asked = spark.range(500).selectExpr(
        "cast(id as string) pair_id", "cast(60 + id % 40 as int) threshold",
        "if(id % 50 = 0, 'no text', cast(null as string)) input_error")
    # Replies lack some pairs and have some that nobody asked for.
    judged = spark.range(100, 600).selectExpr(
        "cast(id as string) pair_id", "cast(id % 101 as int) judge_score", "'line' reason")
    plain = sorted(map(str, replies.judge_pairs(asked, judged).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = ("asked_by_key", "judged_by_key")
    try:
        sides = [write_by_key(t, n, 5, path=str(tmp_path / n)) for t, n in zip((asked, judged), names)]
        verdict = replies.judge_pairs(*sides)
        plan = verdict._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, verdict.collect())) == plain and len(plain) == 500
        assert all(len(list((tmp_path / n).glob("*.parquet"))) == 5 for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
