"""Fixed values restated from the survey's citations, not taken from the code under test."""

from gradeframe.functions import http, stopwords
from gradeframe.operators import agents, attempts, lexical, replies, requests

RETRY = dict.fromkeys(("RATE_LIMIT", "SERVER", "NETWORK"), "retry") | {"OK": "accept"}


def test_waits_and_attempts():
    assert (http.MAX_ATTEMPTS, http.FIRST_WAIT_MS, http.LONGEST_WAIT_MS, http.DIRECT_WAIT_MS) == (5, 1000, 30_000, 2000)


def test_chains():
    assert attempts.JUDGE_CHAIN == ("gpt-4.1-mini", "gpt-5-nano", "gpt-4o-mini")
    assert attempts.VISION_CHAIN == ("gpt-5-nano", "gpt-4.1-mini", "gpt-4o-mini")


def test_policies():
    assert attempts.POLICIES == {
        "chat": RETRY | {"CLIENT": "abort", "ENVELOPE": "retry", "BAD_JSON": "retry", "SCHEMA": "retry"},
        "responses": RETRY | {"CLIENT": "next", "ENVELOPE": "retry", "BAD_JSON": "abort", "SCHEMA": "next"},
        "vision": RETRY | {"CLIENT": "next", "ENVELOPE": "abort", "BAD_JSON": "abort", "SCHEMA": "abort"},
        "direct": RETRY | {"CLIENT": "abort", "ENVELOPE": "abort", "BAD_JSON": "abort", "SCHEMA": "abort"},
    }


def test_thresholds_lists_and_names():
    assert lexical.CONTAINMENT_THRESHOLD == 60 and replies.JUDGE_THRESHOLD == 75
    assert len(stopwords.BASE) == len(set(stopwords.BASE)) == 172
    assert agents.TOOLS == ("search_order", "create_refund", "check_policy")
    assert (agents.ID_ARGUMENT, agents.SUCCESS_WORD) == ("order_id", "successfully")
    assert requests.DIRECT_TEMPERATURE_MODELS == ("gpt-4.1", "gpt-4o", "gpt-4.1-mini")
