"""The merge of sorted streams: plan, results, and runs that must fail."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessaline.operators import merge

N = 400


def vector(i, salt):
    a = (i * 7 + salt) % 360
    return [math.cos(math.radians(a)), math.sin(math.radians(a))]


def stored(spark, folder, previous=None, encoded=None, plan=None):
    """Items 0 to N; every third changed, every tenth new; the previous run has items that are gone."""
    change = lambda i: "new" if i % 10 == 0 else "changed" if i % 3 == 0 else "unchanged"
    plan = plan if plan is not None else [(f"i{i:04d}", f"h{i}", change(i)) for i in range(N)]
    previous = previous if previous is not None else [(f"i{i:04d}", f"h{i}" if i % 3 else f"old{i}", vector(i, 1)) for i in range(N) if i % 10] + [(f"i{i:04d}x", "gone", vector(i, 2)) for i in range(0, N, 4)]
    encoded = encoded if encoded is not None else [(f"i{i:04d}", f"h{i}", vector(i, 3)) for i in range(N) if change(i) != "unchanged"]
    row = "item_id string, content_hash string, embedding array<float>"
    return [
        merge.write_sorted(spark.createDataFrame(rows, schema), f"{folder}/{name}", 4)
        for name, rows, schema in (("plan", plan, "item_id string, content_hash string, change string"), ("previous", previous, row), ("encoded", encoded, row))
    ]


def test_merge_without_exchange_or_sort(spark, tmp_path):
    out = merge.merge_sorted(*stored(spark, tmp_path), 2)
    rows = {r.item_id: r for r in out.collect()}
    assert sorted(rows) == [f"i{i:04d}" for i in range(N)]
    for i in range(N):
        reused = i % 10 != 0 and i % 3 != 0
        r = rows[f"i{i:04d}"]
        assert r.reused == reused and r.content_hash == f"h{i}" and r.embedding == pytest.approx(vector(i, 1 if reused else 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    ids = out.select("item_id", F.spark_partition_id().alias("p")).collect()
    for p in {r.p for r in ids}:
        own = [r.item_id for r in ids if r.p == p]
        assert own == sorted(own)


def broken(spark, folder, **sides):
    with pytest.raises(PythonException) as e:
        merge.merge_sorted(*stored(spark, folder, **sides), 2).collect()
    return str(e.value)


def rewrite(folder, order):
    """Bucket files with their rows in another order."""
    for name in map(Path, glob.glob(f"{folder}/previous/part-*.parquet")):
        table = pq.read_table(name)
        pq.write_table(table.take(order(table.num_rows)), name)
        name.with_name(f".{name.name}.crc").unlink()


def test_a_broken_order_fails(spark, tmp_path):
    plan, previous, encoded = stored(spark, tmp_path)
    rewrite(tmp_path, lambda n: list(range(n))[::-1])
    with pytest.raises(PythonException, match="sorted|not in the previous run"):
        merge.merge_sorted(plan, previous, encoded, 2).collect()


def test_deleted_rows_out_of_order_fail_too(spark, tmp_path):
    plan, previous, encoded = stored(spark, tmp_path, plan=[("z", "h", "new")], encoded=[("z", "h", [1.0, 0.0])])
    rewrite(tmp_path, lambda n: [1, 0, *range(2, n)])
    with pytest.raises(PythonException, match="previous run is not sorted"):
        merge.merge_sorted(plan, previous, encoded, 2).collect()


def test_what_a_run_must_not_hold(spark, tmp_path):
    one = [("a", "h", "unchanged")]
    assert "not in the previous run" in broken(spark, tmp_path / "1", plan=one, previous=[], encoded=[])
    assert "another hash" in broken(spark, tmp_path / "2", plan=one, previous=[("a", "x", [1.0, 0.0])], encoded=[])
    assert "repeats a" in broken(spark, tmp_path / "3", plan=one, previous=[("a", "h", [1.0, 0.0])] * 2, encoded=[])
    assert "no unit vector" in broken(spark, tmp_path / "4", plan=one, previous=[("a", "h", [2.0, 0.0])], encoded=[])
    assert "no unit vector" in broken(spark, tmp_path / "5", plan=one, previous=[("a", "h", [float("nan"), 0.0])], encoded=[])
    assert "another dimension" in broken(spark, tmp_path / "6", plan=one, previous=[("a", "h", [1.0])], encoded=[])
    assert "not in the encoded rows" in broken(spark, tmp_path / "7", plan=[("a", "h", "new")], previous=[], encoded=[])
    assert merge.merge_sorted(*stored(spark, tmp_path / "8", plan=[], previous=[], encoded=[]), 2).collect() == []
