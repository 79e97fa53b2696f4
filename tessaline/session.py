"""Session construction and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessaline")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settle(spark: SparkSession) -> None:
    """Spark 4.1 lets a union report its inputs' partitioning, which adaptive coalescing can then change for one input only; without it, a shuffle is planned."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by any path that Spark's readers can open."""
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else without, for the planner to deal."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that all executors share (spark.checkpoint.dir); only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="tessaline-")
        context.setCheckpointDir(configured)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, so that a lost executor costs no recomputation of the lineage."""
    settle(df.sparkSession)
    shared_folder(df.sparkSession, "")  # sets the folder
    return df.checkpoint(eager=True)
