"""Session settings and the shared folder used for streaming state."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(
    name: str = "gradeframe", cores: str = "*", memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given.

    Adaptive execution sizes the shuffles at run time, so the partition count
    here is only the starting point for a single machine.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_KEY, checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of ``name`` below the folder the cluster names in its settings.

    There is no machine-local default: a job that loses an executor must find
    its state again from another host.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        raise ValueError(f"{CHECKPOINT_KEY} is not set; name a shared folder or pass a path")
    return f"{root.rstrip('/')}/{name}"
