"""Joins of two streams whose rows arrive apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cases_with_runs(
    cases: DataFrame, runs: DataFrame, asked_at: str = "asked_at", run_at: str = "run_at", within: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Test cases and the runs that follow them in time, each a stream; ``reject`` tells why a side is missing.

    A run belongs to its case if it comes up to ``within`` after it. A case without such a run, and a run without
    such a case, become reject rows once the watermark, ``delay`` behind the latest time, has passed them;
    then their state is dropped.
    """
    case = cases.withWatermark(asked_at, delay).alias("c")
    run = runs.withWatermark(run_at, delay).withColumnRenamed("test_id", "_run_id").alias("r")
    start, end = F.col(f"c.{asked_at}"), F.col(f"r.{run_at}")
    same = (F.col("test_id") == F.col("_run_id")) & (end >= start) & (end <= start + F.expr(f"INTERVAL {within}"))
    reject = F.when(F.col("_run_id").isNull(), "No run in time").when(F.col("test_id").isNull(), "No case in time")
    joined = case.join(run, same, "full_outer").withColumn("reject", reject)
    return joined.withColumn("test_id", F.coalesce("test_id", "_run_id")).drop("_run_id")
