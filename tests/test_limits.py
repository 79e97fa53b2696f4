"""Token buckets on streams against the batch replay."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessaline.streaming import limits, state

SCHEMA = "bucket_id string, ip string, seq long, ts timestamp, cost double"
START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def log(seed=1, n=400, keys=6, gap=0.8):
    rng, now, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        now += rng.choice([0, rng.expovariate(1 / gap)])
        rows.append((f"u{rng.randrange(keys)}", f"ip{rng.randrange(3)}", seq, START + timedelta(seconds=round(now, 3)), rng.choice([1.0, 1.0, 2.0])))
    return rows


def files(spark, rows, folder, sizes):
    at = 0
    for size in sizes:
        spark.createDataFrame(rows[at : at + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        at += size


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("now", F.unix_micros("ts") / 1e6)


def decided(df):
    return sorted(tuple(r) for r in df.select("bucket_id", "seq", "allowed", "tokens", "retry_after").collect())


@pytest.mark.parametrize(("deny_spends_time", "instances"), [(False, 1), (True, 3)])
def test_stream_equals_replay_across_batches_and_a_restart(spark, tmp_path, deny_spends_time, instances):
    rows = log()
    stream = lambda: limits.token_bucket_stream(source(spark, tmp_path), 3.0, 0.5, deny_spends_time, instances)
    files(spark, rows, tmp_path, [70, 90])
    limits.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    files(spark, rows[160:], tmp_path, [1, 239])
    limits.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")  # goes on from the checkpoint
    want = decided(state.token_bucket(batch(spark, rows), 3.0, 0.5, deny_spends_time, instances))
    got = decided(spark.read.parquet(f"{tmp_path}/out"))
    assert got == want and {r[2] for r in got} == {True, False}


def test_states_go_after_their_time(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    many = [(f"k{i}", "x", i, at(i / 100), 1.0) for i in range(60)]
    later = [("late", "x", 100, at(400), 1.0)]
    again = [("k5", "x", 101, at(500), 2.0), ("late", "x", 102, at(500), 1.0)]
    files(spark, [*many, *later, *again], tmp_path, [60, 1, 2])
    assert limits.ttl_seconds(2.0, 0.5) == 8 and limits.ttl_seconds(0.1, 5.0) == 2
    query = limits.run_available(limits.token_bucket_stream(source(spark, tmp_path), 2.0, 0.5), f"{tmp_path}/out", f"{tmp_path}/cp")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 60 and kept[-1] < 12  # value and timer of the few that are left
    want = decided(state.token_bucket(batch(spark, [*many, *later, *again]), 2.0, 0.5))
    assert decided(spark.read.parquet(f"{tmp_path}/out")) == want


def test_two_tiers(spark, tmp_path):
    rows = log(4, 240, 5, 0.5)
    files(spark, rows, tmp_path, [100, 140])
    limits.run_available(limits.two_tier_stream(source(spark, tmp_path), "ip", "bucket_id", (4.0, 1.0), (2.0, 0.4)), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = {tuple(r) for r in state.two_tiers(batch(spark, rows), "ip", "bucket_id", (4.0, 1.0), (2.0, 0.4)).select("seq", "allowed", "denied_by").collect()}
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("seq", "allowed", "denied_by").collect()}
    assert got == want and {d for _, _, d in got} == {None, "ip", "bucket_id"}
