"""Golden queries, query vectors and exact top-k search for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.vectors import clamp, mean_vectors, norm, normalise

FILTER_FIELDS = ("brand", "category", "language")
QUERY_BLOCK, ITEM_BLOCK = 512, 2048  # vectors in a block
BROADCAST_BYTES = 64 << 20  # of packed queries; beyond it blocks of both sides are dealt to tasks
NORM_TOLERANCE = 1e-3
DIGITS = 6  # scores are compared rounded, so that ties are ties whatever the order of summation


def filter_predicate(filters: dict[str, str] | None) -> Column | None:
    """Conjunction of equalities over the allowed fields; blank values are ignored; absent metadata never matches. A plain comparison, which reaches the scan."""
    for field, value in (filters or {}).items():
        if field not in FILTER_FIELDS:
            raise ValueError(f"unknown filter field: {field}")
        if not isinstance(value, str):
            raise TypeError(f"filter {field} must be a string")
    parts = [F.col(f) == filters[f].strip() for f in FILTER_FIELDS if filters and filters.get(f, "").strip()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def query_vectors(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, vector) from (query_id, item_id) and item vectors: unit mean of the stored vectors; unknown seeds are skipped."""
    found = seeds.distinct().join(items.select("item_id", "vector"), "item_id")
    return mean_vectors(found, "query_id", "vector").select("query_id", normalise(F.col("vector")).alias("vector")).filter("vector IS NOT NULL")


def valid_query(vector: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    """Whether a vector can be asked for: no null or non-finite component, and of length 1."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & (F.abs(norm(vector) - 1) <= tolerance), F.lit(False))


PACKED = "ids array<string>, dim int, data binary"


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to size vectors of one length."""
    for whole in batches:
        dims = np.array(whole.column(1).value_lengths())
        for dim in np.unique(dims):
            rows = whole.filter(pa.array(dims == dim))
            for start in range(0, rows.num_rows, size):
                part = rows.slice(start, size)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([int(dim)], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["ids", "dim", "data"])


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that reach the k-th of their row, ties included."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, dtype=bool))
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= cut[:, None])


def _keep_best(ids: np.ndarray, scores: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each owner by (score descending, id)."""
    order = np.lexsort([ids.astype(str), -scores, owner])
    ids, scores, owner = ids[order], scores[order], owner[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    return ids[keep], scores[keep], owner[keep]


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best k of one task for each query, from pairs of a block of queries and a block of items. Holds k items a query."""
    held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["dim"] != row["item_dim"]:
                raise ValueError(f"queries of {row['dim']} components, items of {row['item_dim']}")
            matrix, block = (np.frombuffer(row[c]).reshape(-1, row["dim"]) for c in ("data", "item_data"))
            found = np.round(matrix @ block.T, DIGITS)
            q, i = _best(found, k)
            key, names = tuple(row["ids"]), np.array(row["item_ids"], dtype=object)
            have = held.get(key, (np.empty(0, object), np.empty(0), np.empty(0, np.int64)))
            held[key] = _keep_best(np.concatenate([have[0], names[i]]), np.concatenate([have[1], found[q, i]]), np.concatenate([have[2], q]), k)
    for key, (ids, scores, owner) in held.items():
        names = np.array(key, dtype=object)[owner]
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(scores)], ["query_id", "item_id", "score"])


def search(queries: DataFrame, items: DataFrame, k: int, filters: dict[str, str] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): exact cosine top-k of unit vectors, ties by item_id, scores clamped to 0..1 after ranking.

    Filters and column pruning reach the scan. Both sides are packed into blocks of vectors; every pair of
    blocks is one matrix product, and a task keeps k rows a query, so the shuffle holds tasks *
    queries * k rows. Blocks of queries are broadcast up to BROADCAST_BYTES and dealt with the items'
    blocks beyond. exclude holds (query_id, item_id) that must not appear: as many more are fetched as a query
    excludes at most. A query that is no unit vector, and items of another length, are errors;
    items without a vector are skipped.
    """
    if k < 1:
        raise ValueError("k must be positive")
    predicate = filter_predicate(filters)
    corpus = (items if predicate is None else items.filter(predicate)).select("item_id", "vector").filter("vector IS NOT NULL")
    asked = queries.select("query_id", F.when(valid_query(F.col("vector")), F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit("no unit vector: "), "query_id"))).alias("vector"))
    more = 0
    if exclude is not None:
        more = exclude.distinct().groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    left = asked.mapInArrow(partial(_pack, size=QUERY_BLOCK), PACKED)
    size = queries.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8 + 64), F.lit(0)).alias("n")).first().n
    right = corpus.mapInArrow(partial(_pack, size=ITEM_BLOCK), PACKED).select(F.col("ids").alias("item_ids"), F.col("dim").alias("item_dim"), F.col("data").alias("item_data"))
    pairs = right.crossJoin(F.broadcast(left) if size <= BROADCAST_BYTES else left)
    found = pairs.mapInArrow(partial(_compare, k=k + more), "query_id string, item_id string, score double")
    if exclude is not None:
        found = found.join(exclude.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return top_k(found, k).withColumn("score", clamp(F.col("score")))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, ranked from 1 by (score descending, item_id)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def drop_seeds(found: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Results without a query's own seeds, cut to k and ranked again."""
    return top_k(found.drop("rank").join(seeds.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"), k)
