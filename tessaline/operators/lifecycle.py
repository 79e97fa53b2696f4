"""Incremental plans, merges and the index registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.hashing import sha256
from tessaline.functions.ordered_digest import ordered_sha256
from tessaline.session import cut


def change_plan(new: DataFrame, previous: DataFrame) -> DataFrame:
    """(item_id, change) by content_hash: new, changed, unchanged or deleted."""
    n = new.select("item_id", F.col("content_hash").alias("n"))
    p = previous.select("item_id", F.col("content_hash").alias("p"))
    change = F.when(F.col("p").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("n") == F.col("p"), "unchanged").otherwise("changed")
    return n.join(p, "item_id", "full_outer").select("item_id", change.alias("change"))


def snapshot_hash(items: DataFrame) -> DataFrame:
    """One row: the identity of a catalog, over its id:hash lines sorted by both. The lines stream through one hash state; no value holds them."""
    items = cut(items.select("item_id", "content_hash"))  # hashed once; dealing by ranges reads it twice
    lines = items.select("item_id", "content_hash", F.concat_ws(":", "item_id", "content_hash").alias("line"))
    found = ordered_sha256(lines, [], [F.col("item_id"), F.col("content_hash")], F.col("line"), "\n")
    whole = F.coalesce(F.max("sha256"), sha256(F.lit("")))
    return found.agg(F.concat(F.lit("sha256:"), F.substring(whole, 1, 16)).alias("snapshot"))


def merge_run(plan: DataFrame, previous: DataFrame, encoded: DataFrame) -> DataFrame:
    """The rows of the next run: unchanged items from the previous one, new and changed ones as encoded."""
    reused = previous.join(plan.filter("change = 'unchanged'").select("item_id"), "item_id", "left_semi")
    fresh = encoded.join(plan.filter("change IN ('new', 'changed')").select("item_id"), "item_id", "left_semi")
    return reused.unionByName(fresh)


def upsert(existing: DataFrame, rows: DataFrame, key: str, kept: list[str], now) -> DataFrame:
    """existing with rows written over it: columns in kept (created_at) stay as they were, updated_at becomes now where a row was written."""
    old, new = existing.alias("o"), rows.withColumn("_written", F.lit(True)).alias("n")
    joined = old.join(new, key, "full_outer")
    columns = [F.col(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c == "updated_at":
            columns.append(F.when(F.col("n._written"), now).otherwise(F.col("o.updated_at")).alias(c))
        elif c == "created_at":
            columns.append(F.coalesce("o.created_at", now).alias(c))
        elif c in kept or c not in rows.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        else:
            columns.append(F.when(F.col("n._written"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def no_changes(plan: DataFrame, previous_snapshot: str | None, snapshot: DataFrame) -> DataFrame:
    """(to_encode, unchanged, deleted, no_changes): nothing is to be done only if nothing is to be encoded and the catalog's identity is the same, so a mere deletion makes a new run."""
    count = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    counts = plan.agg(count("new", "changed").alias("to_encode"), count("unchanged").alias("unchanged"), count("deleted").alias("deleted"))
    return counts.crossJoin(F.broadcast(snapshot)).select("to_encode", "unchanged", "deleted", ((F.col("to_encode") == 0) & F.col("snapshot").eqNullSafe(F.lit(previous_snapshot))).alias("no_changes"))


def merge_errors(plan: DataFrame, previous: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """(item_id, reason): what forbids to merge a run: an unchanged item that the previous run lacks, holds twice or under another hash, and vectors that no run may hold."""
    from tessaline.sources.files import invalid_embeddings

    kept = plan.filter("change = 'unchanged'").select("item_id")
    have = previous.groupBy("item_id").agg(F.count("*").alias("n"), F.min("content_hash").alias("h"))
    rows = kept.join(new.select("item_id", "content_hash"), "item_id").join(have, "item_id", "left")
    reason = F.when(F.col("n").isNull(), "absent from the previous run").when(F.col("n") > 1, "repeated in the previous run").when(F.col("h") != F.col("content_hash"), "another hash in the previous run")
    found = rows.select("item_id", reason.alias("reason")).filter("reason IS NOT NULL")
    return found.unionByName(invalid_embeddings(previous.join(kept, "item_id", "left_semi"), dim))


def promotion(registry: DataFrame, target: str, counts: DataFrame) -> DataFrame:
    """(index_version, outcome): promoted, already_active, not_found, or why it is refused (status, row_count). counts: (index_version, stored)."""
    asked = registry.sparkSession.createDataFrame([(target,)], "index_version string")
    rows = asked.join(registry.select("index_version", "status", "row_count"), "index_version", "left").join(counts, "index_version", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "active", "already_active").when(~F.col("status").isin("building", "retired"), "status")
    return rows.select("index_version", outcome.when(F.col("row_count") != F.coalesce("stored", F.lit(0)), "row_count").otherwise("promoted").alias("outcome"))


def promote(registry: DataFrame, target: str, counts: DataFrame, now) -> DataFrame:
    """The registry after promoting target where promotion allows it, else unchanged. At most one index is active."""
    go = promotion(registry, target, counts).select((F.col("outcome") == "promoted").alias("go"))
    rows = registry.crossJoin(F.broadcast(go))  # one row
    mine = F.col("index_version") == target
    retire = F.col("go") & (F.col("status") == "active")
    status = F.when(F.col("go") & mine, "active").when(retire, "retired").otherwise(F.col("status"))
    return rows.withColumn("activated_at", F.when(F.col("go") & mine, now).otherwise(F.col("activated_at"))).withColumn("retired_at", F.when(F.col("go") & mine, None).when(retire, now).otherwise(F.col("retired_at"))).withColumn("status", status).drop("go")


def latest_retired(registry: DataFrame) -> DataFrame:
    return registry.filter("status = 'retired'").orderBy(F.desc_nulls_last("retired_at"), "index_version").limit(1).select("index_version")


def rollback(registry: DataFrame, counts: DataFrame, now) -> DataFrame:
    """The registry after promoting the index that was retired last."""
    target = latest_retired(registry).first()
    if target is None:
        raise LookupError("no retired index to roll back to")
    return promote(registry, target.index_version, counts, now)


def register_build(registry: DataFrame, version: str, fields: dict[str, object], row_count: int) -> DataFrame:
    """The registry with a new building index; a building row that a crash left is replaced. Columns that fields do not name stay null."""
    own = {**fields, "index_version": version, "status": "building", "row_count": row_count}
    row = registry.sparkSession.range(1).select(*[F.lit(own.get(c)).cast(registry.schema[c].dataType).alias(c) for c in registry.columns])
    return registry.filter(~((F.col("index_version") == version) & (F.col("status") == "building"))).unionByName(row)


def is_duplicate(registry: DataFrame, version: str) -> bool:
    """Whether an index of this version exists already, other than one that a crash left unfinished."""
    return not registry.filter((F.col("index_version") == version) & (F.col("status") != "building")).isEmpty()


def cascade_delete(embeddings: DataFrame, items: DataFrame) -> DataFrame:
    """Embeddings whose item still exists."""
    return embeddings.join(items.select("item_id"), "item_id", "left_semi")


def prune(rows: DataFrame, version: str, order: str, keep: int) -> DataFrame:
    """Rows of the versions that come last by the greatest of order; ties by the version's name."""
    newest = rows.groupBy(version).agg(F.max(order).alias("newest")).orderBy(F.desc("newest"), version).limit(keep).select(version)
    return rows.join(F.broadcast(newest), version, "left_semi")  # keep rows


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
