"""Popularity snapshots, fallback tiers and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.hashing import sha256, synthetic_popularity
from tessaline.session import small


def refresh_snapshot(items: DataFrame, size: int) -> DataFrame:
    """The first size items by md5 of their id, ranked from 1; a top-k before the window keeps it bounded."""
    first = items.select("item_id", "category", "brand", "language", F.md5("item_id").alias("order")).orderBy("order").limit(size)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("order"))).drop("order")


def read_snapshot(snapshot: DataFrame, k: int, filters: dict[str, str | None] | None = None) -> DataFrame:
    """(item_id, rank, score): the first k by rank among rows that match; score is 1 - rank / (largest rank of all + 1). Filters on unknown fields are ignored."""
    most = snapshot.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("most"))  # one row
    rows = snapshot
    for field, value in (filters or {}).items():
        if field not in snapshot.columns:
            continue
        rows = rows.filter(F.lit(value).isNull() | (F.col(field) == F.lit(value)))
    rows = rows.orderBy("rank").limit(k)
    return rows.crossJoin(F.broadcast(most)).select("item_id", "rank", (1 - F.col("rank") / (F.col("most") + 1)).alias("score"))


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Of several relations with the same columns, for each key the rows of the first that has any; tier counts from 1."""
    rows = None
    for number, tier in enumerate(tiers, 1):
        own = tier.withColumn("tier", F.lit(number))
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("best", F.min("tier").over(Window.partitionBy(key))).filter("tier = best").drop("best")


def random_baseline(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Per query the first k items by SHA-256 of query_id, a zero byte and item_id; score k - position. Nothing for k below 1. Tasks keep k rows a query before the shuffle (a group limit under the window)."""
    pairs = items.select("item_id").crossJoin(small(queries.select("query_id")))
    order = Window.partitionBy("query_id").orderBy(sha256(F.concat("query_id", F.lit("\0"), "item_id")), "item_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", (F.lit(k) - (F.col("rank") - 1)).cast("double"))


def popularity_baseline(queries: DataFrame, items: DataFrame, k: int, popularity: DataFrame | None = None) -> DataFrame:
    """The k most popular items for every query, ties by item_id; synthetic popularity unless a table is given (absent: 0)."""
    if popularity is None:
        scored = items.select("item_id", synthetic_popularity(F.col("item_id")).alias("score"))
    else:
        scored = items.select("item_id").join(popularity, "item_id", "left").select("item_id", F.coalesce("popularity", F.lit(0.0)).alias("score"))
    best = scored.orderBy(F.desc("score"), "item_id").limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))
    return queries.select("query_id").crossJoin(F.broadcast(best))  # k rows
