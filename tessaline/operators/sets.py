"""Request predicates, labels, seed keys and small generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions.vectors import dot

#: What the name or the message of an error holds and the kind it tells, in the order they are tried.
ERROR_RULES = (("name or message", "timeout", "timeout"), ("message", "refused", "connection_refused"), ("message", "auth", "auth_failed"), ("message", "password", "auth_failed"), ("name", "connection", "connection_refused"), ("name", "operational", "connection_refused"))
#: The classes of errors that mean that a dependency did not answer.
FAILURE_CLASSES = (
    "ConnectionError", "ConnectionRefusedError", "ConnectionResetError", "ConnectionAbortedError", "BrokenPipeError", "TimeoutError", "TimeoutExpired",
    "OperationalError", "InterfaceError", "BusyLoadingError", "ConnectionPoolExhausted",
)


def valid_request(user: Column, seeds: Column, k: Column) -> Column:
    return F.length(user).between(1, 128) & (seeds <= 50) & k.between(1, 100)


def error_kind(name: Column, message: Column) -> Column:
    """The kind of an error by its class name and message."""
    where = {"name": [F.lower(name)], "message": [F.lower(message)], "name or message": [F.lower(name), F.lower(message)]}
    out = None
    for place, part, kind in ERROR_RULES:
        test = F.lit(False)
        for text in where[place]:
            test = test | F.coalesce(text.contains(part), F.lit(False))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def counts_as_failure(name: Column) -> Column:
    """Whether an error's class tells that a dependency did not answer."""
    return F.coalesce(name.isin(*FAILURE_CLASSES), F.lit(False))


def readiness(checks: DataFrame, *by: str) -> DataFrame:
    """(by, status, http_code) of (required, ok): not ready if a required check fails, degraded if another one does."""
    fails = lambda kind: F.count(F.when((F.col("required") == kind) & ~F.coalesce("ok", F.lit(False)), 1))
    g = checks.groupBy(*by).agg(fails(True).alias("required"), fails(False).alias("optional"))
    status = F.when(F.col("required") > 0, "not_ready").when(F.col("optional") > 0, "degraded").otherwise("ready")
    return g.select(*by, status.alias("status"), F.when(F.col("required") > 0, 503).otherwise(200).alias("http_code"))


def missing_and_extra(fields: Column, known: tuple[str, ...]) -> tuple[Column, Column]:
    """Names of known fields that are missing, and of others that are there."""
    all_known = F.array(*map(F.lit, known))
    return F.array_sort(F.array_except(all_known, fields)), F.array_sort(F.array_except(fields, all_known))


def seed_key(seeds: Column) -> Column:
    """Seeds without repeats, in order: equal sets have equal keys."""
    return F.array_sort(F.array_distinct(seeds))


def source_label(cache_hit: Column, ann_ok: Column, tier3: Column, tier4: Column) -> Column:
    """Where an answer came from: the first tier that has one."""
    return F.when(cache_hit, "cache").when(ann_ok, "ann").when(tier3, "fallback_ann").when(tier4, "fallback_cached").otherwise("none")


def arm_status(rows: DataFrame, arm: str, missing: str) -> DataFrame:
    """(arm, missing_rate, status) of one row a query, or of none: degraded if a provider failed for all queries, error for an arm without any."""
    n = F.count(missing)
    status = F.when(n == 0, "error").when(F.bool_and(F.col(missing)), "degraded").otherwise("ok")
    return rows.groupBy(arm).agg(F.coalesce(F.avg(F.col(missing).cast("double")), F.lit(0.0)).alias("missing_rate"), status.alias("status"))


def sample_catalog(spark: SparkSession, topics: int, each: int, brands: int) -> DataFrame:
    """A deterministic catalog: item_id, topic, brand, and the role of each item in its topic's golden query."""
    n = spark.range(topics * each)
    at = (F.col("id") % each).cast("int")
    return n.select(F.format_string("i_%04d", F.col("id") + 1).alias("item_id"), F.concat(F.lit("topic "), F.floor(F.col("id") / each).cast("string")).alias("topic"), F.concat(F.lit("brand "), (at % brands).cast("string")).alias("brand"), F.when(at < 3, "seed").otherwise("relevant").alias("role"))


def centroid_cosine(means: DataFrame, key: str) -> DataFrame:
    """One row: the cosine of two centroids, keys 0 and 1."""
    pick = lambda k: F.first(F.when(F.col(key) == k, F.col("vector")), ignorenulls=True)
    g = means.agg(pick(0).alias("a"), pick(1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.select((dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).alias("cosine"))
