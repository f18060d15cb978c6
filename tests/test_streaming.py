import pytest
from pyspark.sql import functions as F

from gradeframe.functions import text
from gradeframe.operators import attempts, lexical, questions, replies, requests, rules
from gradeframe.plans import fixtures
from gradeframe.session import shared_folder
from gradeframe.sources.tables import once_delivered
from gradeframe.streaming.joins import cases_with_runs
from gradeframe.streaming.runner import latest, run_keyed, run_per_batch, run_recomputed, run_row_local

FOLDER = "/root/testdata/sf0.001"


def staged(spark, frame, tmp_path, files=3):
    """The frame as a folder of parquet files, read back one file per micro-batch."""
    path = str(tmp_path / "in")
    frame.repartition(files).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(frame):
    return sorted(map(str, (r.asDict(recursive=True) for r in frame.select(sorted(frame.columns)).collect())))


STEPS = {
    "containment": (fixtures.pairs, lexical.with_containment),
    "cosine_verdict": (lambda s, f: fixtures.pairs(s, f).withColumn("threshold", F.lit(5.0)), lambda d: lexical.with_cosine_verdict(d, ["the"])),
    "stemmed": (fixtures.pairs, lexical.with_stemmed_cosine),
    "tokens": (fixtures.documents, lambda d: d.select("doc_id", text.clean_tokens(F.col("text"), []).alias("t"))),
    "rules": (fixtures.question_inputs, lambda d: rules.with_input_error(d, rules.question_input_error())),
    "requests": (lambda s, f: fixtures.pairs(s, f).withColumn("prompt", F.lit("p")), requests.with_judge_request),
    "replies": (fixtures.chat_replies, lambda d: replies.check_judge_schema(replies.parse_chat(d))),
    "images": (
        lambda s, f: fixtures.images(s, f).withColumns({"model": F.lit("m"), "prompt": F.lit("p")}),
        requests.with_vision_request,
    ),
    "questions": (
        fixtures.question_replies,
        lambda d: questions.question_rows(questions.check_questions(questions.parse_questions(d))),
    ),
    "outcomes": (
        fixtures.attempts,
        lambda d: attempts.with_wait(attempts.with_outcome(replies.check_judge_schema(replies.parse_responses(d))), "responses"),
    ),
}


@pytest.mark.parametrize("name", list(STEPS))
def test_stream_equals_batch(spark, tmp_path, name):
    source, step = STEPS[name]
    batch, stream = staged(spark, source(spark, FOLDER), tmp_path)
    sink = str(tmp_path / "out")
    run_row_local(stream, step, sink, f"parity_{name}_{tmp_path.name}").awaitTermination(120)
    wanted = step(batch)
    got = spark.read.schema(wanted.schema).parquet(sink)
    assert rows(got) == rows(wanted) and wanted.count() > 0


def test_restart_adds_only_new_rows(spark, tmp_path):
    frame = fixtures.pairs(spark, FOLDER)
    _, stream = staged(spark, frame, tmp_path)
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        run_row_local(stream, lexical.with_containment, sink, "restart", state).awaitTermination(120)
    assert spark.read.parquet(sink).count() == frame.count()
    frame.write.mode("append").parquet(str(tmp_path / "in"))
    run_row_local(stream, lexical.with_containment, sink, "restart", state).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 2 * frame.count()


def test_partitioned_sink(spark, tmp_path):
    _, stream = staged(spark, fixtures.pairs(spark, FOLDER).withColumn("threshold", F.lit(1.0)), tmp_path)
    sink = tmp_path / "out"
    run_row_local(stream, lambda d: lexical.with_cosine_verdict(d, []), str(sink), "parts", str(tmp_path / "s"), ("status",)).awaitTermination(120)
    assert {p.name for p in sink.glob("status=*")} <= {"status=PASS", "status=FAIL"} and list(sink.glob("status=*"))


def test_joins_run_per_batch(spark, tmp_path):
    log = replies.check_judge_schema(replies.parse_responses(fixtures.attempts(spark, FOLDER)))
    outcomes = attempts.with_outcome(log).select("pair_id", "preferred_model", "model", "attempt_no", "outcome", "judge_score", "reason")
    batch, stream = staged(spark, outcomes, tmp_path, files=1)

    def step(d):
        return attempts.resolve_attempts(d, "responses")

    run_per_batch(stream, step, str(tmp_path / "out"), "resolve", str(tmp_path / "state")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch_id")) == rows(step(batch))


def test_keys_split_over_batches_are_resolved_whole(spark, tmp_path):
    log = replies.check_judge_schema(replies.parse_responses(fixtures.attempts(spark, FOLDER)))
    outcomes = attempts.with_outcome(log).select("pair_id", "preferred_model", "model", "attempt_no", "outcome", "judge_score", "reason")
    batch, stream = staged(spark, outcomes, tmp_path, files=3)  # a round robin: every key is in several files

    def step(d):
        return attempts.resolve_attempts(d, "responses")

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run_recomputed(stream, step, str(tmp_path / "log"), out, "recompute", "pair_id", state).awaitTermination(120)
    assert rows(latest(spark, out, "pair_id")) == rows(step(batch))


def outcomes_of(spark):
    log = replies.check_judge_schema(replies.parse_responses(fixtures.attempts(spark, FOLDER)))
    return attempts.with_outcome(log).select("pair_id", "preferred_model", "model", "attempt_no", "outcome", "judge_score", "reason")


@pytest.mark.parametrize("policy", ["responses", "chat"])
def test_ends_per_place_are_the_state_of_a_stream(spark, tmp_path, policy):
    batch, stream = staged(spark, outcomes_of(spark), tmp_path, files=3)  # every key is in several files
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = run_keyed(attempts.resolve_attempts(stream, policy), out, f"keyed_{policy}", state)
    query.awaitTermination(120)
    assert rows(latest(spark, out, "pair_id")) == rows(attempts.resolve_attempts(batch, policy))
    read = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert len(read) == 3 and sum(read) == batch.count() and max(read) < 1.2 * min(read)  # no batch reads earlier rows


def test_state_of_old_requests_is_dropped(spark, tmp_path):
    """A request's state goes when the watermark on its time has passed it."""
    log = outcomes_of(spark).where("length(pair_id) <= 2")
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for day in (1, 5, 9):
        log.withColumn("asked_at", F.lit(f"2024-01-0{day} 10:00:00").cast("timestamp")).withColumn(
            "pair_id", F.concat(F.lit(f"d{day}-"), "pair_id")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("asked_at", "1 day")
    query = run_keyed(attempts.resolve_attempts(stream, "responses", asked_at="asked_at"), out, "expiring", state)
    query.awaitTermination(120)
    got = latest(spark, out, "pair_id")
    assert rows(got) == rows(attempts.resolve_attempts(spark.read.parquet(path), "responses", asked_at="asked_at"))
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    keys = log.select("pair_id").distinct().count()
    assert held[-1] <= keys < got.count() == 3 * keys


def test_totals_of_a_growing_table(spark, tmp_path):
    checked = questions.check_questions(questions.parse_questions(fixtures.question_replies(spark, FOLDER)))
    batch, stream = staged(spark, questions.question_totals(checked), tmp_path, files=3)
    out, state = str(tmp_path / "out"), tmp_path / "state"
    run_keyed(questions.totals_by_status(stream), out, "totals", str(state)).awaitTermination(120)
    wanted = rows(questions.totals_by_status(batch))
    assert rows(latest(spark, out, "status")) == wanted and len(wanted) == 2
    for commit in (state / "commits").glob("*2*"):  # as if the last batch had not been noted: it comes again
        commit.unlink()
    run_keyed(questions.totals_by_status(stream), out, "totals", str(state)).awaitTermination(120)
    assert rows(latest(spark, out, "status")) == wanted


def test_a_reply_delivered_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "in")
    times = {1: "10:00", 2: "10:20", 3: "15:00", 4: "19:00"}
    deliveries = [(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "a", 2), (3, "c", 1), (4, "d", 1)]
    for n, time in times.items():
        own = [(p, "m", k, f"2024-01-01 {time}:00") for b, p, k in deliveries if b == n]
        spark.createDataFrame(own, "pair_id string, model string, attempt_no int, at string").withColumn(
            "at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    query = run_row_local(stream, lambda d: once_delivered(d, "at"), out, "delivered", str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted((r.pair_id, r.attempt_no) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1)]
    assert once_delivered(spark.read.parquet(path), "at").count() == 5
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress][-1] <= 2  # the morning's names are gone


def test_cases_and_runs_arriving_apart(spark, tmp_path):
    def side(name, column, batches):
        for own in batches:
            spark.createDataFrame([(t, f"2024-01-01 {at}:00") for t, at in own], f"test_id string, {column} string").withColumn(
                column, F.col(column).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        path = str(tmp_path / name)
        return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)

    cases = side("cases", "asked_at", [[("t1", "10:00"), ("t2", "10:00"), ("t3", "10:01")], [("t4", "10:30")], [("z", "20:00")], [("z", "23:00")]])
    runs = side("runs", "run_at", [[("t1", "10:05")], [("t2", "10:59"), ("t3", "11:30")], [("z", "20:01")], [("z", "23:01")]])
    out = str(tmp_path / "out")
    run_row_local(cases, lambda d: cases_with_runs(d, runs), out, "apart", str(tmp_path / "state")).awaitTermination(180)
    got = sorted((r.test_id, r.reject or "") for r in spark.read.parquet(out).where("test_id <> 'z'").collect())
    assert got == [("t1", ""), ("t2", ""), ("t3", "No case in time"), ("t3", "No run in time"), ("t4", "No run in time")]


def test_state_lives_in_the_shared_folder(spark):
    assert shared_folder(spark, "streams/x").endswith("/streams/x")


class NoFolder:
    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_no_machine_local_default():
    with pytest.raises(ValueError):
        shared_folder(NoFolder, "x")
