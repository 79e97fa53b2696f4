"""Merge of a plan, the previous run and newly encoded rows as three sorted streams.

Each side is stored in BUCKETS buckets by the hash of item_id, one sorted file a bucket, so equal ids meet in one
task without an exchange and without a sort. One pass over the joined streams takes the previous
vector of unchanged items and the encoded one of the others, skips what the catalog no longer holds, and fails
where an id breaks the order, comes twice or lacks its vector: a run that is not sorted is corrupt. A task holds a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
NORM_TOLERANCE = 1e-3
MERGED = "item_id string, content_hash string, embedding array<float>, reused boolean"


def write_sorted(rows: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """rows stored in path as sorted buckets of item_id; returns the table."""
    spark = rows.sparkSession
    name = f"run_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "item_id").sortWithinPartitions("item_id")
    dealt.write.bucketBy(buckets, "item_id").sortBy("item_id").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class BrokenRun(ValueError):
    """A run that must not be merged."""


def _rising(ids: pa.Array, last: str | None, what: str) -> str | None:
    """The last of ids, which rise strictly from last on; BrokenRun otherwise."""
    ids = ids.drop_null()
    if not len(ids):
        return last
    steps = pa.concat_arrays([pa.array([last], ids.type), ids]) if last is not None else ids
    wrong = pc.less_equal(steps[1:], steps[:-1])
    if pc.any(wrong).as_py():
        at = pc.index(wrong, True).as_py()
        kind = "repeats" if steps[at] == steps[at + 1] else "is not sorted at"
        raise BrokenRun(f"the {what} {kind} {steps[at + 1].as_py()}")
    return ids[-1].as_py()


def _check_vectors(vectors: pa.Array, ids: pa.Array, dim: int) -> None:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise BrokenRun(f"item {ids[int(np.argmax(lengths != dim))]} has another dimension than {dim}")
    size = np.linalg.norm(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), axis=1)
    wrong = ~(np.abs(size - 1) <= NORM_TOLERANCE)  # NaN is wrong too
    if wrong.any():
        raise BrokenRun(f"item {ids[int(np.argmax(wrong))]} has no unit vector")


def merge_sorted(plan: DataFrame, previous: DataFrame, encoded: DataFrame, dim: int) -> DataFrame:
    """(item_id, content_hash, embedding, reused), in order within each bucket.

    plan: (item_id, content_hash, change), change unchanged, new or changed; previous and encoded: (item_id, content_hash,
    embedding); all three by write_sorted with one number of buckets. An item of encoded that the plan does not ask for is ignored.
    """
    spark = plan.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file
    side = lambda df, p: df.select(F.col("item_id").alias(f"{p}_id"), F.col("content_hash").alias(f"{p}_hash"), F.col("embedding").cast("array<float>").alias(f"{p}_vector"))
    asked = plan.select("item_id", "content_hash", "change")
    joined = asked.hint("merge").join(side(encoded, "new").hint("merge"), F.col("item_id") == F.col("new_id"), "left")
    joined = joined.hint("merge").join(side(previous, "old").hint("merge"), F.col("item_id") == F.col("old_id"), "full_outer")
    joined = joined.select("item_id", "content_hash", "change", "new_id", "new_hash", "new_vector", "old_id", "old_hash", "old_vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {"plan": None, "previous run": None}
        for batch in batches:
            rows = pa.Table.from_batches([batch]).combine_chunks()
            get = lambda t, c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
            last["previous run"] = _rising(get(rows, "old_id"), last["previous run"], "previous run")
            rows = rows.filter(pc.is_valid(rows.column("item_id")))  # others are gone from the catalog
            last["plan"] = _rising(get(rows, "item_id"), last["plan"], "plan")
            reuse = pc.equal(rows.column("change"), "unchanged")
            for own, p, what in ((rows.filter(reuse), "old", "previous run"), (rows.filter(pc.invert(reuse)), "new", "encoded rows")):
                lost = pc.or_(pc.is_null(own.column(f"{p}_id")), pc.is_null(own.column(f"{p}_vector")))
                if pc.any(lost).as_py():
                    raise BrokenRun(f"item {own.column('item_id').filter(lost)[0]} is not in the {what}, or these are not sorted")
                other = pc.not_equal(own.column(f"{p}_hash"), own.column("content_hash"))
                if pc.any(other).as_py():
                    raise BrokenRun(f"item {own.column('item_id').filter(other)[0]} has another hash in the {what}")
                if own.num_rows:
                    _check_vectors(get(own, f"{p}_vector"), get(own, "item_id"), dim)
            if rows.num_rows:
                vectors = pc.if_else(reuse, rows.column("old_vector"), rows.column("new_vector"))
                yield from pa.table({"item_id": rows.column("item_id"), "content_hash": rows.column("content_hash"), "embedding": vectors, "reused": reuse}).to_batches()

    return joined.mapInArrow(run, MERGED)
