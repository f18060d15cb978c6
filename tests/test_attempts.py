import random

import pytest
from pyspark.sql import functions as F

from gradeframe.functions.http import http_outcome, retry_after_ms
from gradeframe.operators import attempts

CHAIN = attempts.JUDGE_CHAIN
SCHEMA = ("pair_id string, preferred_model string, model string, attempt_no int, outcome string, "
          "judge_score int, reason string")


@pytest.mark.parametrize("status, wanted", [
    (200, "OK"), (299, "OK"), (429, "RATE_LIMIT"), (500, "SERVER"), (599, "SERVER"), (404, "CLIENT"),
    (301, "CLIENT"), (100, "CLIENT"),
])
def test_http_outcome(one, status, wanted):
    assert one(http_outcome(F.col("x")), x=status) == wanted


@pytest.mark.parametrize("header, wanted", [
    ("2", 2000), (" 7 ", 7000), ("abc", 0), (None, 0), ("-1", -1000), ("1.5", 0), ("9223372036854775807", 0),
])
def test_retry_after(one, header, wanted):
    assert one(retry_after_ms(F.col("x")), x=header) == wanted


def waits(spark, policy, rows):
    frame = spark.createDataFrame(rows, "outcome string, attempt_no int, retry_after string")
    return [r.wait_ms for r in attempts.with_wait(frame, policy).collect()]


def test_capped_waits(spark):
    rows = [("RATE_LIMIT", n, None) for n in range(1, 6)] + [("SERVER", n, "9") for n in range(1, 6)]
    rows += [("RATE_LIMIT", 5, "45"), ("RATE_LIMIT", 1, "2"), ("RATE_LIMIT", 1, "-3"), ("OK", 1, None),
             ("CLIENT", 1, None), ("SCHEMA", 2, None), ("RATE_LIMIT", 6, None)]
    assert waits(spark, "chat", rows) == [1000, 2000, 4000, 8000, 16000, 1000, 2000, 4000, 8000, 0,
                                          30000, 2000, 1000, 0, 0, 2000, 0]
    assert waits(spark, "responses", [("SCHEMA", 2, None), ("BAD_JSON", 1, None), ("ENVELOPE", 3, None)]) == [0, 0, 4000]


def test_direct_waits(spark):
    rows = [("RATE_LIMIT", n, None) for n in range(1, 6)] + [("SERVER", n, None) for n in range(1, 6)]
    rows += [("RATE_LIMIT", 2, "45"), ("NETWORK", 3, None), ("CLIENT", 1, None), ("BAD_JSON", 1, None)]
    assert waits(spark, "direct", rows) == [2000, 4000, 8000, 16000, 0, 2000, 4000, 6000, 8000, 0, 45000, 6000, 0, 0]


@pytest.mark.parametrize("preferred, wanted", [
    (CHAIN[0], list(CHAIN)), (CHAIN[1], list(CHAIN[1:])), (CHAIN[2], [CHAIN[2]]), ("mine", ["mine", *CHAIN]),
])
def test_model_order(one, preferred, wanted):
    assert one(attempts.model_order(F.col("x")), x=preferred) == wanted


def search(rows, policy, chain, preferred):
    """The call loop itself, over the logged attempts of one pair."""
    order = list(chain[chain.index(preferred):]) if preferred in chain else [preferred, *chain]
    log = {(m, n): (o, s, r) for _, _, m, n, o, s, r in rows}
    moved_on = False
    for model in order:
        moved_on = False
        for n in range(1, 6):
            if (model, n) not in log:
                continue
            outcome, score, reason = log[model, n]
            action = attempts.POLICIES[policy][outcome]
            if action == "accept":
                return "ACCEPTED", model, n, score, reason
            if action == "abort":
                return "ABORTED", None, n, None, None
            if action == "retry" and n == 5:
                return "RETRIES_USED_UP", None, n, None, None
            if action == "next":
                moved_on = True
                break
        if not moved_on:
            return "INCOMPLETE", None, None, None, None  # the next model was never asked
    return ("MODELS_USED_UP" if moved_on else "INCOMPLETE"), None, None, None, None


@pytest.mark.parametrize("policy", list(attempts.POLICIES))
def test_search_against_the_loop(spark, policy):
    rng = random.Random(policy)
    outcomes = list(attempts.POLICIES[policy])
    weights = [1, 6, 6, 4, 2, 2, 1, 2]
    chain = CHAIN if policy in ("responses", "vision") else CHAIN[:1]
    rows, wanted = [], {}
    for p in range(250):
        key = f"p{p}"
        preferred = rng.choice([None, *CHAIN, "mine"]) if len(chain) > 1 else None
        mine = []
        for model in [*CHAIN, "mine", "stranger"]:
            last = rng.choice([5, 5, 7, 2])
            for n in range(1, last + 1):
                outcome = rng.choices(outcomes, weights)[0]
                mine.append((key, preferred, model, n, outcome, rng.randint(0, 100), f"r{n}"))
        rows += mine
        wanted[key] = search(mine, policy, chain, preferred or chain[0])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.pair_id: (r.end_state, r.model_used, r.attempt_no, r.judge_score, r.reason)
           for r in attempts.resolve_attempts(frame, policy, chain).collect()}
    assert got == wanted
    assert len({v[0] for v in wanted.values()}) >= 3


def test_models_behind_an_open_search_do_not_count(spark):
    rows = [("a", None, CHAIN[0], 1, "SERVER", 1, "r"), ("a", None, CHAIN[0], 2, "SERVER", 1, "r"), ("a", None, CHAIN[1], 1, "OK", 2, "r"),
            ("b", None, CHAIN[0], 1, "SERVER", 1, "r"), ("b", None, CHAIN[2], 1, "CLIENT", 1, "r")]
    got = attempts.resolve_attempts(spark.createDataFrame(rows, SCHEMA), "responses").collect()
    assert {(r.pair_id, r.end_state, r.model_used) for r in got} == {("a", "INCOMPLETE", None), ("b", "INCOMPLETE", None)}


def test_one_shuffle_with_map_side_combine(spark):
    frame = spark.createDataFrame([("p", None, CHAIN[0], 1, "OK", 5, "r")], SCHEMA)
    plan = attempts.resolve_attempts(frame, "chat", CHAIN[:1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "partial_min" in plan


def test_repeated_log_rows_give_one_answer(spark):
    rows = [("p", None, CHAIN[0], 1, "OK", 9, "b"), ("p", None, CHAIN[0], 1, "OK", 9, "a")] * 5
    got = attempts.resolve_attempts(spark.createDataFrame(rows, SCHEMA).repartition(4), "chat", CHAIN[:1]).collect()
    assert len(got) == 1 and got[0].reason == "a"


def test_outcome_reads_http_before_reply(spark):
    frame = spark.createDataFrame([(200, None), (200, "SCHEMA"), (500, "BAD_JSON"), (None, "BAD_JSON")],
                                  "http_status int, error_class string")
    assert [r.outcome for r in attempts.with_outcome(frame).collect()] == ["OK", "SCHEMA", "SERVER", "NETWORK"]
