"""Ranking metrics, reports and the gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.text import iso_timestamp, too_old
from tessaline.session import small


def ideal_gain(n: Column) -> Column:
    """Sum of 1 / log2(i + 1) for i from 1 to n."""
    return F.when(n >= 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def query_metrics(results: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """(system, query_id, recall, ndcg, mrr) of (system, query_id, item_id, rank) against (query_id, relevant array).

    Nothing relevant: recall 1, ndcg 0; the reciprocal rank is not cut at k.
    """
    systems = results.select("system").distinct()
    asked = golden.select("query_id", "relevant").crossJoin(small(systems))
    hits = results.join(golden.select("query_id", F.explode(F.array_distinct("relevant")).alias("item_id")), ["query_id", "item_id"])
    inside = F.col("rank") <= k
    per = hits.groupBy("system", "query_id").agg(F.count(F.when(inside, 1)).alias("hits"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias("gain"), F.min("rank").alias("first"))
    joined = asked.join(per, ["system", "query_id"], "left")
    n = F.size(F.array_distinct("relevant"))
    most = F.least(n, F.lit(k))
    recall = F.when(n == 0, 1.0).when(F.lit(k) <= 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / most)
    ndcg = F.when((n == 0) | (F.lit(k) <= 0), 0.0).otherwise(F.coalesce("gain", F.lit(0.0)) / ideal_gain(most))
    return joined.select("system", "query_id", recall.alias("recall"), ndcg.alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def fidelity(approximate: DataFrame, exact: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, fidelity): shared top-k items by k; 1 if both are empty."""
    cut = lambda df, flag: df.filter(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias(flag)).distinct()
    pairs = cut(approximate, "a").join(cut(exact, "e"), ["query_id", "item_id"], "full_outer")
    shared = pairs.groupBy("query_id").agg(F.count(F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), 1)).alias("shared"))
    joined = queries.select("query_id").join(shared, "query_id", "left")
    return joined.select("query_id", F.when(F.col("shared").isNull(), 1.0).otherwise(F.col("shared") / k).alias("fidelity"))


def mean_fidelity(approximate: DataFrame, exact: DataFrame, queries: DataFrame, k: int, system: str, metric: str) -> DataFrame:
    """One report row (system, metric, value): the mean over queries."""
    return fidelity(approximate, exact, queries, k).agg(F.coalesce(F.avg("fidelity"), F.lit(0.0)).alias("value")).select(F.lit(system).alias("system"), F.lit(metric).alias("metric"), "value")


def report(metrics: DataFrame, k: int) -> DataFrame:
    """Long report (system, metric, value): means over queries; 0 without queries."""
    names = {"recall": f"recall_at_{k}", "ndcg": f"ndcg_at_{k}", "mrr": "mrr"}
    means = metrics.groupBy("system").agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(name) for m, name in names.items()])
    return means.unpivot("system", list(names.values()), "metric", "value")


@dataclass(frozen=True)
class GateRules:
    """What a report must be before its metrics count; None: not checked."""

    golden_set_version: str
    commit: str | None = None
    now: str | None = None  # a time with an offset
    max_age_hours: float | None = 24.0
    required: tuple[str, ...] = ()


def metric_failures(values: DataFrame, limits: DataFrame, informational: list[str] | frozenset[str]) -> DataFrame:
    """(system, metric, kind, value, threshold) of (system, metric, value) against (system, metric, kind, threshold).

    A value below a floor or the system's own threshold fails, each for itself. Informational systems fail
    only above their own floors. Null values and metrics without a threshold are skipped.
    """
    limits = F.broadcast(limits.filter("threshold IS NOT NULL"))  # a declared file
    known = F.col("system").isin(*informational) if informational else F.lit(False)
    above = known & (F.col("kind") == "informational_floor") & (F.col("value") > F.col("threshold"))
    below = ~known & F.col("kind").isin("per_system", "absolute_floor") & (F.col("value") < F.col("threshold"))
    found = values.filter("value IS NOT NULL AND NOT isnan(value)").join(limits, ["system", "metric"])
    return found.filter(above | below).select("system", "metric", "kind", "value", "threshold")


def gate(values: DataFrame, limits: DataFrame, header: DataFrame, rules: GateRules, informational: list[str] | frozenset[str] = ()) -> DataFrame:
    """One row for the first stage that fails (version, commit, age, required systems), with its reason; else one for each failing metric; else a single row that passed.

    header is one row (golden_set_version, commit, created_at) of the report.
    """
    reason = F.when(~F.col("golden_set_version").eqNullSafe(F.lit(rules.golden_set_version)), "golden_set_version")
    if rules.commit is not None:
        reason = reason.when(~F.col("commit").eqNullSafe(F.lit(rules.commit)), "commit")
    if rules.now is not None and rules.max_age_hours is not None:
        old = too_old(F.col("created_at"), iso_timestamp(F.lit(rules.now)), rules.max_age_hours)
        reason = reason.when(F.col("created_at").isNull(), "created_at is missing").when(old.isNull(), "created_at is no time").when(old, "age")
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, rules.required)).cast("array<string>"), F.coalesce("systems", F.array().cast("array<string>"))))
    reason = reason.when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", ")))
    systems = values.select("system").distinct().agg(F.collect_set("system").alias("systems"))  # the report's systems, a few
    stage = header.crossJoin(F.broadcast(systems)).select(reason.alias("reason"))
    failures = metric_failures(values, limits, informational).withColumn("fails", F.lit(True))
    joined = stage.join(F.broadcast(failures), F.col("reason").isNull(), "left")
    return joined.select((F.col("reason").isNull() & F.col("fails").isNull()).alias("passed"), "reason", "system", "metric", "kind", "value", "threshold")
