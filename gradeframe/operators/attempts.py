"""Attempt logs: read each attempt's outcome and find the reply that counts.

A policy is a table from outcome to action. Every policy runs through the same
single aggregation, so adding one changes data, not code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.http import MAX_ATTEMPTS, http_outcome, wait_ms

# Model order of the text judge and of image reading.
JUDGE_CHAIN = ("gpt-4.1-mini", "gpt-5-nano", "gpt-4o-mini")
VISION_CHAIN = ("gpt-5-nano", "gpt-4.1-mini", "gpt-4o-mini")

# What each policy does with an outcome.
POLICIES: dict[str, dict[str, str]] = {
    # chat judge and question generation: one model, broken replies are asked again
    "chat": {
        "OK": "accept", "RATE_LIMIT": "retry", "SERVER": "retry", "NETWORK": "retry",
        "CLIENT": "abort", "ENVELOPE": "retry", "BAD_JSON": "retry", "SCHEMA": "retry",
    },
    # responses judge: a refusal or a broken schema moves on to the next model
    "responses": {
        "OK": "accept", "RATE_LIMIT": "retry", "SERVER": "retry", "NETWORK": "retry",
        "CLIENT": "next", "ENVELOPE": "retry", "BAD_JSON": "abort", "SCHEMA": "next",
    },
    # image reading: only a refusal moves on, a broken envelope ends the search
    "vision": {
        "OK": "accept", "RATE_LIMIT": "retry", "SERVER": "retry", "NETWORK": "retry",
        "CLIENT": "next", "ENVELOPE": "abort", "BAD_JSON": "abort", "SCHEMA": "abort",
    },
    # direct client: one model, anything but a full or silent server ends it
    "direct": {
        "OK": "accept", "RATE_LIMIT": "retry", "SERVER": "retry", "NETWORK": "retry",
        "CLIENT": "abort", "ENVELOPE": "abort", "BAD_JSON": "abort", "SCHEMA": "abort",
    },
}


def action_of(outcome: Column, policy: str) -> Column:
    """The policy's action for an outcome column."""
    rules = POLICIES[policy]
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), outcome)


def model_order(preferred: Column, chain: Sequence[str] = JUDGE_CHAIN) -> Column:
    """Models to try: the chain from the preferred one on, or the preferred one and then the chain.

    Models ahead of a preferred chain member are not tried.
    """
    models = F.array(*[F.lit(m) for m in chain])
    return F.when(
        F.array_contains(models, preferred),
        F.slice(models, F.array_position(models, preferred).cast("int"), len(chain)),
    ).otherwise(F.concat(F.array(preferred), models))


def with_outcome(attempts: DataFrame) -> DataFrame:
    """Adds ``outcome``: the HTTP class, or for a 2xx the reply's ``error_class`` if it has one."""
    http = http_outcome(F.col("http_status"))
    return attempts.withColumn(
        "outcome", F.when(http == "OK", F.coalesce("error_class", F.lit("OK"))).otherwise(http)
    )


def with_wait(attempts: DataFrame, policy: str) -> DataFrame:
    """Adds ``wait_ms`` from ``outcome``, ``attempt_no`` and ``retry_after``."""
    outcome = F.col("outcome")
    wait = wait_ms(
        outcome, action_of(outcome, policy), F.col("attempt_no"), F.col("retry_after"),
        direct=policy == "direct",
    )
    return attempts.withColumn("wait_ms", wait)


def resolve_attempts(
    attempts: DataFrame,
    policy: str,
    chain: Sequence[str] = JUDGE_CHAIN,
    payload: Sequence[str] = ("judge_score", "reason"),
    key: str = "pair_id",
    most: int = MAX_ATTEMPTS,
    asked_at: str | None = None,
) -> DataFrame:
    """One row per key: how the search ended, and the winning reply if there is one.

    Columns read: ``model``, ``preferred_model`` (null for the chain's first),
    ``attempt_no``, ``outcome`` and the payload.

    For each place in the model order the attempt that ends it is the least one
    that is not a retry; the last allowed retry ends it too. These minima are
    combined map-side, so a key that fills a third of the log still reaches the
    shuffle as one row per task, and the winner carries its payload along. Minima
    of structs sort each task's rows before and after the shuffle; there is no
    join back. An end counts only if every earlier model was refused.

    The same aggregation runs over a stream: its state is the ends of each place, not the log. ``asked_at`` names
    the time of the request, the same in all its attempts; it stays in the result, and with a watermark on it
    the state of old requests is dropped.
    """
    keys = [key, *([asked_at] if asked_at else [])]
    order = model_order(F.coalesce("preferred_model", F.lit(chain[0])), chain)
    places = range(1, len(chain) + 2)
    ranked = (
        attempts.select(*keys, "model", "attempt_no", "outcome", *payload, order.alias("_order"))
        .withColumn("_place", F.array_position("_order", F.col("model")).cast("int"))
        .withColumn("_places", F.size("_order"))
        .withColumn("_action", action_of(F.col("outcome"), policy))
        .withColumn(
            "_action",
            F.when((F.col("_action") == "retry") & (F.col("attempt_no") == most), "exhausted")
            .when(F.col("_action") != "retry", F.col("_action")),
        )
    )
    counted = F.col("_action").isNotNull() & F.col("attempt_no").between(1, most)
    kept = [F.when(F.col("_action") == "accept", F.col(c)).alias(c) for c in payload]
    stop = F.struct(F.col("attempt_no"), F.col("_action").alias("action"), F.col("model"), *kept)
    ends = ranked.groupBy(*keys).agg(
        F.max("_places").alias("_places"),
        *[F.min(F.when(counted & (F.col("_place") == p), stop)).alias(f"_end{p}") for p in places],
    )
    final = ("accept", "abort", "exhausted")
    reached, decided, refused = F.lit(True), [], []
    for p in places:
        action = F.col(f"_end{p}.action")
        decided.append(F.when(reached & action.isin(*final), F.col(f"_end{p}")))
        # A model is asked only after the one before it was refused.
        reached = reached & F.coalesce(action == "next", F.lit(False))
        refused.append(F.when(reached & (F.col("_places") == p), True))
    decided, last_refused = F.coalesce(*decided), F.coalesce(*refused)
    return (
        ends.withColumn("_end", decided)
        .withColumn(
            "end_state",
            F.when(F.col("_end.action") == "accept", "ACCEPTED")
            .when(F.col("_end.action") == "abort", "ABORTED")
            .when(F.col("_end.action") == "exhausted", "RETRIES_USED_UP")
            .when(last_refused, "MODELS_USED_UP")
            .otherwise("INCOMPLETE"),
        )
        .select(
            *keys, "end_state",
            F.when(F.col("_end.action") == "accept", F.col("_end.model")).alias("model_used"),
            F.col("_end.attempt_no").alias("attempt_no"),
            *[F.col(f"_end.{c}").alias(c) for c in payload],
        )
    )
