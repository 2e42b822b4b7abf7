"""Session construction and cluster-safe helpers shared by every operator.

Nothing here holds data. The helpers only decide *how* Spark should execute a plan:
the session defaults (UTC, ANSI, AQE) and where lineage is cut (the shared checkpoint
directory named by the cluster).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Defaults that every oracle-exact result depends on.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "millrun") -> SparkSession:
    """Local session for tests and the bench. On a cluster the session comes from the launcher."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MILLRUN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a scratch one only in a local session (tests, bench).

    On a cluster each executor has its own temporary folder, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="millrun-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Fixed value: rows that one task of a wide join or aggregate is given where the session's own shuffles would give it more.
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int = ROWS_A_TASK) -> int | None:
    """Tasks for ``rows`` rows at ``rows_a_task`` each; None where the session's shuffles have that many anyway."""
    n = -(-rows // rows_a_task)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for every ``rows_a_task`` rows, if that is more tasks than the session's shuffles have.

    A join or aggregate by the keys then runs in as many tasks, so what a task holds does not grow with the table. Counts the
    rows at once: for a projection of a Parquet table that reads the footers only.
    """
    n = tasks_for(df.sparkSession, df.count(), rows_a_task)
    return df.repartition(n, *keys) if n else df
