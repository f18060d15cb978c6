"""Outcome of one call in an attempt log, and the wait it asks for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Attempts per model, first wait and longest wait in milliseconds.
MAX_ATTEMPTS = 5
FIRST_WAIT_MS = 1_000
LONGEST_WAIT_MS = 30_000
# Fixed value: first wait of the "direct" policy, which knows no longest wait.
DIRECT_WAIT_MS = 2_000


def http_outcome(status: Column) -> Column:
    """OK, RATE_LIMIT, SERVER, CLIENT, or NETWORK when no status came back."""
    return (
        F.when(status.isNull(), "NETWORK")
        .when(status.between(200, 299), "OK")
        .when(status == 429, "RATE_LIMIT")
        .when(status >= 500, "SERVER")
        .otherwise("CLIENT")
    )


def retry_after_ms(header: Column) -> Column:
    """Seconds of a Retry-After header as milliseconds; 0 when absent or not a number."""
    seconds = F.trim(header).try_cast("bigint")
    return F.coalesce(F.try_multiply(seconds, F.lit(1000).cast("bigint")), F.lit(0).cast("bigint"))


def _doubling(first_ms: int, attempt_no: Column) -> Column:
    return (F.lit(first_ms) * F.pow(F.lit(2.0), attempt_no - 1)).cast("bigint")


def wait_ms(outcome: Column, action: Column, attempt_no: Column, header: Column, direct: bool = False) -> Column:
    """Milliseconds to wait after an attempt, without jitter.

    ``action`` is the policy's reading of the outcome. The usual policies wait
    once more after a rate limit on the last attempt; ``direct`` does not.
    """
    asked = retry_after_ms(header)
    last = attempt_no >= MAX_ATTEMPTS
    nothing = F.lit(0).cast("bigint")
    counted = attempt_no.between(1, MAX_ATTEMPTS)
    if direct:
        limited = F.when(asked > 0, asked).otherwise(_doubling(DIRECT_WAIT_MS, attempt_no))
        other = (F.lit(DIRECT_WAIT_MS) * attempt_no).cast("bigint")
        wait = F.when(last, nothing).when(outcome == "RATE_LIMIT", limited).when(action == "retry", other)
    else:
        cap = F.lit(LONGEST_WAIT_MS).cast("bigint")
        doubling = _doubling(FIRST_WAIT_MS, attempt_no)
        limited = F.least(F.when(asked > 0, asked).otherwise(doubling), cap)
        wait = F.when(outcome == "RATE_LIMIT", limited).when(
            (action == "retry") & ~last, F.least(doubling, cap)
        )
    return F.coalesce(F.when(counted, wait), nothing)
