"""Session helpers: settings every job relies on, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans are designed around.  All of them are decisions
# Spark takes from measured sizes, so none depends on the scale of a data set.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Exchanges begin as many small partitions, which adaptive execution merges up to a stated size: so a task's share of the rows, and
# what its sorts and aggregates hold at once, follow that size and not the tables. Small tables end up in few tasks all the same.
TASK_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def bound_tasks(spark: SparkSession) -> None:
    """Bounds the share of a task; what the session already says stays."""
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def build_session(app: str = "umbraline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a local one only when none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = os.path.join(tempfile.mkdtemp(prefix="run-"), "checkpoints")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
