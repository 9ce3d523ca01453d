"""Session defaults for local runs, tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "ledgerlens", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with UTC time, AQE and Arrow; the driver's memory is set before the JVM starts."""
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over at least as many tasks as there are cores, for work that costs much a row.

    Only a plain scan of fewer splits than cores is dealt anew, which is a small input: a large one has more splits.
    """
    plan = rows._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where none is set, one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}")
    return spark.sparkContext.getCheckpointDir()


def held(rows: DataFrame) -> DataFrame:
    """The rows without the plan that made them, checkpointed in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
