"""A third of all rows on one key: results stay whole and the plan splits or combines."""

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import agents, attempts, lexical
from gradeframe.sources.pairs import turn_pairs

ROWS = 60_000


@pytest.fixture
def skewed_joins(spark):
    """Settings that make the adaptive skew join act on test-sized data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_backend_id(spark, skewed_joins):
    hot = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("ORD"), F.col("id").cast("string")))
    cases = spark.range(0, ROWS, 1, 8).select(F.col("id").alias("test_id"), hot.alias("expected_order_id"))
    backend = spark.range(0, ROWS, 2, 8).select(F.concat(F.lit("ORD"), F.col("id").cast("string")).alias("order_id"))
    backend = backend.unionByName(spark.range(1000).select(F.lit("HOT").alias("order_id")))
    flagged = agents.with_backend_flag(cases, backend)
    assert "skew=true" in final_plan(flagged)
    got = dict(flagged.groupBy("in_backend").count().collect())
    even = sum(1 for i in range(ROWS) if i % 3 and i % 2 == 0)
    assert got == {True: ROWS // 3 + even, False: ROWS - ROWS // 3 - even}


def test_hot_pair_in_the_log_reaches_the_shuffle_combined(spark):
    n = F.col("id")
    log = spark.range(0, ROWS, 1, 8).select(
        F.when(n % 3 == 0, F.lit("HOT")).otherwise((n % 1000).cast("string")).alias("pair_id"),
        F.lit(None).cast("string").alias("preferred_model"), F.lit(attempts.JUDGE_CHAIN[0]).alias("model"),
        (n % 5 + 1).cast("int").alias("attempt_no"), F.lit("SERVER").alias("outcome"),
        F.lit(1).alias("judge_score"), F.lit("r").alias("reason"),
    )
    got = attempts.resolve_attempts(log, "responses")
    assert got.count() == 1001
    assert [r.end_state for r in got.where("pair_id = 'HOT'").collect()] == ["RETRIES_USED_UP"]
    shuffled = got._jdf.queryExecution().executedPlan().toString()
    assert shuffled.index("partial_min") > shuffled.index("Exchange")  # below it in the tree


def test_one_huge_conversation(spark, skewed_joins):
    n = F.col("id")
    talk = spark.range(0, ROWS, 1, 8).select(
        F.when(n < ROWS // 3, 0).otherwise(n).alias("conv_id"),
        F.when(n < ROWS // 3, n).otherwise(0).alias("turn"),
        F.when(n % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("words of turn "), n.cast("string")).alias("text"),
    )
    pairs = turn_pairs(talk)
    assert pairs.count() == ROWS // 6
    # both keys are hashed, so the hot conversation itself is spread over the partitions
    sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < ROWS // 6


def test_hot_term_is_combined_before_the_stopword_join(spark, skewed_joins):
    pairs = spark.range(0, 2000, 1, 4).select(
        F.col("id").alias("pair_id"),
        F.concat(F.lit("the " * 60), F.col("id").cast("string"), F.lit(" order")).alias("expected"),
        F.concat(F.lit("the order "), (F.col("id") % 7 + 10).cast("string")).alias("actual"),
    )
    words = spark.createDataFrame([("the",)], "word string")
    by_terms = lexical.cosine_by_terms(pairs, words)
    plan = by_terms._jdf.queryExecution().executedPlan().toString()
    join, first_sum = plan.index("LeftAnti"), plan.index("partial_sum(e")
    assert first_sum > 0 and plan.index("partial_sum(e#", join) > join
    row_form = lexical.with_cosine(pairs, ["the"])
    assert by_terms.exceptAll(row_form.select("pair_id", "cosine")).count() == 0


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 50_000}x" for i in range(400_000))
    pairs = spark.createDataFrame([("p", text, text), ("q", "a b", text)], "pair_id string, expected string, actual string")
    got = {r.pair_id: r.cosine for r in lexical.with_cosine(pairs, []).collect()}
    assert got == {"p": 1.0, "q": 0.0}

