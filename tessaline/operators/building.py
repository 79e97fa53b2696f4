"""Index builds and promotions over stored tables: <folder>/index by version, <folder>/registry by number of its change.

A registry is a small table that is written anew with each change; the highest number is the current one.
A tool for a single writer: two that write at once would give their changes the same number. Callers hold a lock
(sources.config.RunLock, of one machine) where several processes change one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions.hashing import canonical_json
from tessaline.operators import lifecycle
from tessaline.sources.config import resolve_collision
from tessaline.sources.files import write_index

REGISTRY = "index_version string, identity string, status string, row_count long, activated_at timestamp, retired_at timestamp"


def _folder_exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _change(spark: SparkSession, folder: str) -> int:
    """The number of the registry's last change; 0 before the first."""
    if not _folder_exists(spark, f"{folder}/registry"):
        return 0
    return spark.read.schema(REGISTRY + ", change int").parquet(f"{folder}/registry").agg(F.coalesce(F.max("change"), F.lit(0)).alias("n")).first().n


def registry(spark: SparkSession, folder: str) -> DataFrame:
    change = _change(spark, folder)
    if not change:
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY + ", change int").parquet(f"{folder}/registry").filter(F.col("change") == change).drop("change")


def _store(rows: DataFrame, folder: str) -> None:
    spark = rows.sparkSession
    rows.coalesce(1).withColumn("change", F.lit(_change(spark, folder) + 1)).write.mode("append").partitionBy("change").parquet(f"{folder}/registry")


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(index_version, stored): rows of each version in the index."""
    if not _folder_exists(spark, f"{folder}/index"):
        return spark.createDataFrame([], "index_version string, stored long")
    return spark.read.parquet(f"{folder}/index").groupBy("index_version").agg(F.count("*").alias("stored"))


def build_index(spark: SparkSession, folder: str, identity: dict[str, object], run: DataFrame) -> tuple[str, str]:
    """(index version, built or duplicate). A build that a crash left is written anew; an index of the same identity is left alone."""
    canonical = canonical_json(identity)
    rows = registry(spark, folder)
    known = {r.index_version: r.identity for r in rows.select("index_version", "identity").collect()}  # a row for each index
    version, _ = resolve_collision(canonical, known)
    if lifecycle.is_duplicate(rows, version) or version in known and not rows.filter((F.col("index_version") == version) & (F.col("row_count") > 0)).isEmpty():
        return version, "duplicate"
    _store(lifecycle.register_build(rows, version, {"identity": canonical}, 0), folder)
    write_index(run, f"{folder}/index", version)
    n = stored_counts(spark, folder).filter(F.col("index_version") == version).first()
    _store(lifecycle.register_build(registry(spark, folder), version, {"identity": canonical}, n.stored if n else 0), folder)
    return version, "built"


def promote(spark: SparkSession, folder: str, target: str, now: Column) -> str:
    """Make an index the active one; returns the outcome."""
    rows, counts = registry(spark, folder), stored_counts(spark, folder)
    outcome = lifecycle.promotion(rows, target, counts).first().outcome
    if outcome == "promoted":
        _store(lifecycle.promote(rows, target, counts, now), folder)
    return outcome


def rollback(spark: SparkSession, folder: str, now: Column) -> tuple[str, str]:
    """(index version, outcome) of promoting the index that was retired last."""
    target = lifecycle.latest_retired(registry(spark, folder)).first()
    if target is None:
        raise LookupError("no retired index to roll back to")
    return target.index_version, promote(spark, folder, target.index_version, now)


def active_version(spark: SparkSession, folder: str) -> str | None:
    row = registry(spark, folder).filter("status = 'active'").first()
    return row.index_version if row else None
