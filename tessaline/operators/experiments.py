"""Deterministic experiment assignment and the exposure log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.hashing import BUCKETS, bucket, effective_salt, exposure_id
from tessaline.session import small

ALLOCATION = "array<struct<variant:string,pct:int>>"


def invalid_experiments(experiments: DataFrame) -> DataFrame:
    """(name, reason) of definitions that break an invariant."""
    total = F.aggregate("allocation", F.lit(0), lambda s, a: s + a["pct"])
    reason = F.when(total != 100, "allocation does not sum to 100").when(F.size(F.array_distinct(F.transform("allocation", lambda a: a["variant"]))) < F.size("allocation"), "repeated variant").when((F.col("status") == "stopped") != F.col("stopped_at").isNotNull(), "stopped_at must be set exactly for stopped experiments")
    rows = experiments.select("name", reason.alias("reason"))
    for column in ("name", "salt"):
        twice = experiments.groupBy(column).agg(F.count("*").alias("n"), F.min("name").alias("first")).filter("n > 1")
        rows = rows.unionByName(twice.select(F.col("first").alias("name"), F.lit(f"repeated {column}").alias("reason")))
    return rows.filter("reason IS NOT NULL")


def with_bounds(allocation):
    """The allocation with lo and hi buckets: cumulative hundredths in declared order."""
    hi = lambda i: F.aggregate(F.slice(allocation, 1, i + 1), F.lit(0), lambda s, a: s + a["pct"]) * 100
    return F.transform(allocation, lambda a, i: F.struct(a["variant"].alias("variant"), (hi(i) - a["pct"] * 100).alias("lo"), hi(i).alias("hi")))


def assign(users: DataFrame, experiments: DataFrame, environment: str, enabled: bool = True) -> DataFrame:
    """(user_id, experiment, bucket, variant, fallback_reason, log_exposure) of every user in every experiment.

    Experiments are a declared set, broadcast if it is small; control is the first variant. Order of
    precedence: disabled, stopped, paused, running; a bucket that no variant covers, or an empty
    allocation, falls to control with allocation_gap. One experiment's state never changes another's row.
    """
    bounds = experiments.select(F.col("name").alias("experiment"), "salt", "status", with_bounds(F.col("allocation")).alias("bounds"), F.get("allocation", F.lit(0))["variant"].alias("control"))
    pairs = users.select("user_id").crossJoin(small(bounds))
    pairs = pairs.withColumn("bucket", bucket(effective_salt(F.lit(environment), F.col("salt")), F.col("user_id")))
    mine = F.filter("bounds", lambda b: (b["lo"] <= F.col("bucket")) & (F.col("bucket") < b["hi"]))
    reason = F.when(~F.lit(enabled), "disabled").when(F.col("status") == "stopped", "stopped").when(F.col("status") == "paused", "paused").when(F.size(mine) == 0, "allocation_gap")
    pairs = pairs.withColumn("fallback_reason", reason)
    variant = F.when(F.col("fallback_reason").isNull(), F.get(mine, F.lit(0))["variant"]).otherwise(F.col("control"))
    logged = ~F.coalesce(F.col("fallback_reason").isin("disabled", "stopped"), F.lit(False))
    return pairs.select("user_id", "experiment", "bucket", variant.alias("variant"), "fallback_reason", logged.alias("log_exposure"))


def exposures(assignments: DataFrame) -> DataFrame:
    """Exposure rows of assignments with a request_id that are to be logged; one id for each experiment and request."""
    return assignments.filter("log_exposure").withColumn("event_id", exposure_id(F.col("experiment"), F.col("request_id"))).drop("log_exposure")


def write_exposures(existing: DataFrame, assignments: DataFrame) -> DataFrame:
    """(event_id, experiment, request_id, inserted, skipped_reason) of every assignment: not logged, one that no store would take (failed), a duplicate of a stored or an earlier row (by seq), or inserted. A row that fails never keeps another from being written."""
    rows = assignments.withColumn("event_id", exposure_id(F.coalesce("experiment", F.lit("")), F.coalesce("request_id", F.lit(""))))
    failed = ~F.coalesce((F.length("experiment") > 0) & (F.length("variant") > 0) & (F.length("request_id") > 0), F.lit(False))
    rows = rows.withColumn("failed", failed)
    first = F.row_number().over(Window.partitionBy("event_id", "log_exposure", "failed").orderBy("seq")) == 1
    rows = rows.withColumn("first", first).join(existing.select("event_id", F.lit(True).alias("stored")), "event_id", "left")
    reason = F.when(~F.col("log_exposure"), "log_exposure_false").when(F.col("failed"), "failed").when(F.col("stored") | ~F.col("first"), "duplicate")
    return rows.withColumn("skipped_reason", reason).select("event_id", "experiment", "request_id", F.col("skipped_reason").isNull().alias("inserted"), "skipped_reason")


def first_reported(assignments: DataFrame, order: list[str]) -> DataFrame:
    """(request_id, experiment, variant): of each request's assignments, the experiment that was declared first, whether or not its exposure was written."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("experiment"))
    return assignments.filter(place > 0).groupBy("request_id").agg(F.min_by(F.struct("experiment", "variant"), F.struct(place, "variant")).alias("r")).select("request_id", "r.*")


FALLBACK_REASONS = ("disabled", "stopped", "paused", "allocation_gap")


def valid_exposure() -> Column:
    """Row checks of the stored exposures."""
    reason = F.col("fallback_reason").isNull() | F.col("fallback_reason").isin(*FALLBACK_REASONS)
    return F.col("user_id_hash").rlike("^[0-9a-f]{64}$") & F.col("bucket").between(0, BUCKETS - 1) & reason & (F.length("experiment") > 0) & (F.length("variant") > 0)
