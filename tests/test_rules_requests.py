import json

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import replies as reply, requests, rules
from gradeframe.sources.files import read_files, read_images, split_documents, with_document_text
from gradeframe.sources.pairs import named_pairs
from gradeframe.sources.schemas import JUDGE_REQUEST, PAIRS, REPLIES, conform
from gradeframe.sources.tables import read_replies, write_requests, write_results
from gradeframe.streaming.runner import run_row_local


@pytest.mark.parametrize("row, wanted", [
    (("e", "a", "p", 0), None), (("e", "a", "p", 100), None),
    ((None, " ", "p", 101), "Expected_Response must not be empty."),
    (("e", "\t", "", 1), "Actual_Response must not be empty."),
    (("e", "a", " ", 1), "Prompt must not be empty."),
    (("e", "a", "p", -1), "Similarity_Threshold must be an integer between 0 and 100."),
    (("e", "a", "p", 101), "Similarity_Threshold must be an integer between 0 and 100."),
    (("e", "a", "p", None), "Similarity_Threshold must be an integer between 0 and 100."),
])
def test_judge_rules(spark, row, wanted):
    frame = spark.createDataFrame([row], "expected string, actual string, prompt string, threshold int")
    got = rules.with_input_error(frame, rules.judge_input_error()).first()
    assert got.input_error == wanted and got.error_kind == (None if wanted is None else "INPUT")


@pytest.mark.parametrize("row, wanted", [
    ((b"x", 1, "p"), None), ((b"x", 50, "p"), None),
    ((b"", 0, "p"), "Document_File_Path must not be empty."),
    ((None, 1, "p"), "Document_File_Path must not be empty."),
    ((b"x", 0, "p"), "Query_Count must be a positive integer."),
    ((b"x", None, "p"), "Query_Count must be a positive integer."),
    ((b"x", 51, "p"), "Query_Count must not exceed 50."),
    ((b"x", 5, "\n"), "Prompt must not be empty."),
])
def test_question_rules(spark, row, wanted):
    frame = spark.createDataFrame([row], "content binary, query_count int, prompt string")
    assert rules.with_input_error(frame, rules.question_input_error()).first().input_error == wanted


def test_rejects_and_good_rows_are_the_input(spark):
    frame = spark.createDataFrame([(1, "e", "a", "p", t) for t in ("5", "abc", None, "300")],
                                  "pair_id int, expected string, actual string, prompt string, threshold string")
    typed = conform(frame, JUDGE_REQUEST)
    assert typed.schema == JUDGE_REQUEST
    good, rejects = rules.split_rejects(rules.with_input_error(typed, rules.judge_input_error()))
    assert (good.count(), rejects.count()) == (1, 3)


NASTY = 'say "hi"\n\tback\\slash é 日 \x01'


def test_chat_request(spark):
    frame = spark.createDataFrame([(NASTY, "b", "base")], "expected string, actual string, prompt string")
    body = json.loads(requests.with_judge_request(frame).first().body)
    assert body["temperature"] == 0 and body["response_format"] == {"type": "json_object"}
    assert [m["role"] for m in body["messages"]] == ["system", "user"]
    user = body["messages"][1]["content"]
    assert user.startswith("base\n\n") and NASTY in user and user.endswith(requests.JUDGE_RULES)


def test_responses_request_temperature(spark):
    frame = spark.createDataFrame([("a", "b", m) for m in ("gpt-4o-mini", "gpt-5-nano")],
                                  "expected string, actual string, model string")
    bodies = {r.model: json.loads(r.body) for r in requests.with_compare_request(frame).collect()}
    assert bodies["gpt-4o-mini"]["temperature"] == 0 and "temperature" not in bodies["gpt-5-nano"]
    assert bodies["gpt-5-nano"]["text"] == {"format": {"type": "json_object"}}
    direct = requests.with_compare_request(frame, requests.DIRECT_TEMPERATURE_MODELS)
    assert all("temperature" not in json.loads(r.body) for r in direct.collect())


def test_question_and_vision_requests(spark):
    frame = spark.createDataFrame([("p", NASTY, 7)], "prompt string, text string, query_count int")
    body = json.loads(requests.with_question_request(frame).first().body)
    assert "response_format" not in body and body["messages"][1]["content"].endswith("objects: 7.")
    images = spark.createDataFrame([("m", "x/A.PNG", b"\x00" * 90, "read")],
                                   "model string, path string, content binary, prompt string")
    body = json.loads(requests.with_vision_request(images).first().body)
    image, words = body["input"][0]["content"]
    assert set(image) == {"type", "image_url"} and image["image_url"].startswith("data:image/png;base64,AAAA")
    assert words == {"type": "input_text", "text": "read"}


def test_sinks_and_reply_source(spark, tmp_path):
    frame = spark.createDataFrame([(NASTY, "b", "base")], "expected string, actual string, prompt string")
    write_requests(requests.with_judge_request(frame.withColumn("pair_id", F.lit(7))), str(tmp_path / "out"))
    (line,) = spark.read.text(str(tmp_path / "out")).collect()
    assert json.loads(line.value)["pair_id"] == "7" and json.loads(json.loads(line.value)["body"])
    replies = spark.createDataFrame([("1", "m", 1, 200, None, "{}")],
                                    "pair_id string, model string, attempt_no int, http_status int, retry_after string, body string")
    replies.write.json(str(tmp_path / "replies"))
    assert read_replies(spark, str(tmp_path / "replies"), "json").first().body == "{}"
    write_results(replies.withColumn("status", F.lit("PASS")), str(tmp_path / "results"))
    assert (tmp_path / "results" / "status=PASS").is_dir()


@pytest.mark.parametrize("stream", [False, True])
def test_replies_find_their_requests(spark, tmp_path, stream):
    asked = spark.range(40).select(F.col("id").cast("string").alias("pair_id"), F.lit("e").alias("expected"), F.lit("a").alias("actual"),
                                   F.lit("p").alias("prompt"), (F.col("id") % 100).cast("int").alias("threshold"),
                                   F.lit(None).cast("string").alias("input_error"), F.lit("m1").alias("model"))
    write_requests(requests.with_judge_request(asked).repartition(3), str(tmp_path / "out"))
    sent = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {s["model"] for s in sent} == {"m1"} and len({s["pair_id"] for s in sent}) == 40
    score = lambda k: json.dumps({requests.SCORE_FIELD: int(k) * 2, requests.REASON_FIELD: f"r{k}"})
    answers = [(s["pair_id"], s["model"], 1, 200, None, json.dumps({"choices": [{"message": {"content": score(s["pair_id"])}}]}))
               for s in reversed(sent) if s["pair_id"] != "5"]
    spark.createDataFrame(answers, REPLIES).repartition(2).write.json(str(tmp_path / "in"))
    read = read_replies(spark, str(tmp_path / "in"), "json", stream=stream)
    judged = reply.check_judge_schema(reply.parse_chat(read)).select("pair_id", "judge_score", "reason")
    if stream:
        run_row_local(judged, lambda d: d, str(tmp_path / "judged"), f"replies_{tmp_path.name}", str(tmp_path / "state")).awaitTermination(120)
        judged = spark.read.parquet(str(tmp_path / "judged"))
    got = {r.pair_id: r for r in reply.judge_pairs(asked, judged).collect()}
    assert all(got[str(i)].judge_score == 2 * i and got[str(i)].status == "PASS" for i in range(40) if i != 5)
    assert (got["5"].status, got["5"].error_kind, got["5"].message) == ("FAIL", "RUNTIME", "Error: no reply")


def test_every_pair_gets_a_verdict(spark):
    asked = spark.createDataFrame([("a", 50, None), ("b", 101, "out of range"), ("c", None, None), ("d", 10, None)],
                                  "pair_id string, threshold int, input_error string")
    judged = spark.createDataFrame([("a", 60, "x"), ("b", 99, "y"), ("d", None, None)], "pair_id string, judge_score int, reason string")
    got = {r.pair_id: (r.judge_score, r.threshold, r.status, r.error_kind, r.message) for r in reply.judge_pairs(asked, judged).collect()}
    assert got == {"a": (60, 50, "PASS", None, "PASS - Similarity Score: 60%"), "b": (None, 101, "FAIL", "INPUT", "Error: out of range"),
                   "c": (None, 75, "FAIL", "RUNTIME", "Error: no reply"), "d": (None, 10, "FAIL", "RUNTIME", "Error: no valid reply")}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="actual"):
        conform(spark.range(1).selectExpr("'1' AS pair_id", "'e' AS expected"), PAIRS)


def test_named_pairs(spark):
    frame = spark.createDataFrame([(7, "want", "got")], "id int, gold string, answer string")
    assert named_pairs(frame, "id", "gold", "answer").schema == PAIRS


def test_documents_from_files(spark, tmp_path):
    files = {"a.txt": b" text \n", "b.txt": b" \n", "c.pdf": b"%PDF-1.7 x", "d.docx": b"PK\x03\x04", "e.txt": "grün".encode()}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = with_document_text(read_files(spark, str(tmp_path)))
    good, rejects = split_documents(read)
    assert sorted(r.text for r in good.collect()) == ["grün", "text"]
    assert sorted(r.document_error for r in rejects.collect()) == [
        "Document is empty.", "No text reader for type docx", "No text reader for type pdf"]


def test_images_from_files(spark, tmp_path):
    for name in ("a.png", "B.PNG", "c.gif", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.media_type for r in read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": "image/png", "B.PNG": "image/png", "c.gif": "image/gif"}


def test_file_bytes_are_read_only_if_selected(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    plan = read_files(spark, str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
