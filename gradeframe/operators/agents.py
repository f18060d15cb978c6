"""Checks of agent tool-call traces.

A trace is one row holding its ordered calls, so all checks inside it are
row-local. Only two steps meet another table: cases with runs, and expected ids
with the backend.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The tool catalogue, the argument compared, the claim looked for.
TOOLS = ("search_order", "create_refund", "check_policy")
ID_ARGUMENT = "order_id"
SUCCESS_WORD = "successfully"

def _first_position(calls: Column, failed) -> Column:
    """Position (from 0) of the first call that fails the test, or null."""
    positions = F.transform(calls, lambda c, i: F.when(failed(c), i))
    return F.array_min(positions)


def with_unknown_tool(runs: DataFrame, tools: Iterable[str] | DataFrame = TOOLS) -> DataFrame:
    """Adds ``unknown_pos`` and ``unknown_tool`` of the first call outside the catalogue.

    An iterable becomes a constant set in the plan. A table joins: the answer depends on the called names
    alone, so each distinct list of names is checked once and joined back.
    """
    if isinstance(tools, DataFrame):
        named = runs.withColumn("_names", tool_names(F.col("tool_calls")))
        calls = named.select("_names").distinct().select("_names", F.posexplode("_names").alias("_pos", "tool_name"))
        unknown = (
            calls.join(tools.select("tool_name").where("tool_name is not null"), "tool_name", "left_anti")
            .groupBy(F.col("_names").alias("_called")).agg(F.min("_pos").alias("unknown_pos"))
        )
        found = named.join(unknown, F.col("_names").eqNullSafe(F.col("_called")), "left").drop("_names", "_called")
    else:
        known = sorted(set(tools))
        unknown = _first_position(
            F.col("tool_calls"), lambda c: F.coalesce(~c.tool_name.isin(*known), F.lit(True))
        )
        found = runs.withColumn("unknown_pos", unknown)
    return found.withColumn("unknown_tool", F.get("tool_calls", F.col("unknown_pos"))["tool_name"])


def id_argument(call: Column) -> Column:
    """The call's id argument; null when the key is missing."""
    return F.element_at(call["arguments"], F.lit(ID_ARGUMENT))


def with_wrong_argument(runs: DataFrame) -> DataFrame:
    """Adds ``wrong_pos`` of the first call whose id argument is not ``expected_order_id``."""
    wrong = _first_position(
        F.col("tool_calls"), lambda c: ~id_argument(c).eqNullSafe(F.col("expected_order_id"))
    )
    return runs.withColumn("wrong_pos", wrong)


def tool_names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["tool_name"])


def same_sequence() -> Column:
    """Names of the calls equal the expected names in order, number and case."""
    return tool_names(F.col("tool_calls")).eqNullSafe(F.col("expected_tools"))


def with_backend_flag(table: DataFrame, backend: DataFrame, key: str = "expected_order_id") -> DataFrame:
    """Adds ``in_backend``: the row's id is in the backend's ``order_id`` column.

    One left join on the distinct ids, without a hint: Spark compares their size with its own threshold.
    The ids are joined by their hash as well, so that both sides are dealt anew after the distinct and the
    adaptive skew join may split a hot id on the left.
    """
    ids = backend.select("order_id").where("order_id is not null").distinct()
    flagged = ids.select(F.col("order_id").alias(key), F.xxhash64("order_id").alias("_dealt"), F.lit(True).alias("_hit"))
    joined = table.withColumn("_dealt", F.xxhash64(key)).join(flagged, [key, "_dealt"], "left")
    return joined.withColumn("in_backend", F.col("_hit").isNotNull()).drop("_hit", "_dealt")


def is_hallucination() -> Column:
    """The answer claims success although the backend has no record."""
    claim = F.coalesce(F.contains("final_answer", F.lit(SUCCESS_WORD)), F.lit(False))
    return claim & ~F.col("in_backend")


def _list_text(names: Column) -> Column:
    shown = F.transform(names, lambda n: F.coalesce(n, F.lit("null")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def agent_verdict(
    cases: DataFrame, runs: DataFrame, backend: DataFrame, tools: Iterable[str] | DataFrame = TOOLS
) -> DataFrame:
    """First failing check of each run, in the fixed order, as ``status``, ``failed_check``, ``message``.

    Calls are checked one by one, existence before arguments; then sequence,
    backend and claim. A case without an expected id is rejected, because a null
    would otherwise equal a missing argument.
    """
    joined = cases.join(runs, "test_id")
    checked = with_backend_flag(with_wrong_argument(with_unknown_tool(joined, tools)), backend)
    far = F.lit(2_147_483_647)
    unknown, wrong = F.coalesce("unknown_pos", far), F.coalesce("wrong_pos", far)
    failed = (
        F.when(F.col("expected_order_id").isNull(), "input")
        .when((unknown < far) & (unknown <= wrong), "tool_exists")
        .when(wrong < far, "tool_params")
        .when(~same_sequence(), "tool_sequence")
        .when(~F.col("in_backend"), "backend_exists")
        .when(is_hallucination(), "hallucination")
    )
    actual_id = F.coalesce(id_argument(F.get("tool_calls", F.col("wrong_pos"))), F.lit("null"))
    check = F.col("failed_check")
    # The texts of the messages.
    message = (
        F.when(check == "input", "expected_order_id must not be null.")
        .when(
            check == "tool_exists",
            F.concat(F.lit("INVALID TOOL DETECTED -> "), F.coalesce("unknown_tool", F.lit("null"))),
        )
        .when(
            check == "tool_params",
            F.concat(
                F.lit("INVALID ORDER ID\nExpected -> "), F.col("expected_order_id"),
                F.lit("\nActual -> "), actual_id,
            ),
        )
        .when(
            check == "tool_sequence",
            F.concat(
                F.lit("TOOL SEQUENCE MISMATCH\nExpected -> "), _list_text(F.col("expected_tools")),
                F.lit("\nActual -> "), _list_text(tool_names(F.col("tool_calls"))),
            ),
        )
        .when(check == "backend_exists", "Refund not created in backend")
        .when(
            check == "hallucination",
            "HALLUCINATION DETECTED!\nAgent claimed refund success but DB has no refund record",
        )
        .otherwise("AI AGENT TEST PASSED")
    )
    return (
        checked.withColumn("failed_check", failed)
        .withColumn(
            "status",
            F.when(check.isNull(), "PASS").when(check == "input", "REJECTED").otherwise("FAIL"),
        )
        .withColumn("message", message)
        .select("test_id", "status", "failed_check", "message")
    )
