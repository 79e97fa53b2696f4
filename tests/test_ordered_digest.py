"""Hashes over ordered rows against hashlib."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tessaline.functions import ordered_digest
from tessaline.functions.ordered_digest import ordered_sha256
from tessaline.operators.lifecycle import snapshot_hash


def plain(rows):
    groups = {}
    for key, at, piece in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(key, []).append(piece)
    return {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in groups.items()}


def test_hash_of_each_key_in_order(spark, monkeypatch):
    monkeypatch.setattr(ordered_digest, "CHUNK", 64)
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaabcdé"), i, rng.choice(["", "x", "éé" * 40, str(i)])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, piece string").repartition(7)
    got = {r.k: r.sha256 for r in ordered_sha256(df, ["k"], [F.col("at")], F.col("piece"), ",").collect()}
    assert got == plain(rows)
    assert ordered_sha256(df.filter("false"), ["k"], [F.col("at")], F.col("piece")).collect() == []


def test_snapshot_of_a_large_catalog_holds_no_list(spark):
    items = spark.range(300_000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), F.sha1(F.col("id").cast("string")).alias("content_hash"))
    lines = sorted((f"i{i}", hashlib.sha1(str(i).encode()).hexdigest()) for i in range(300_000))
    want = hashlib.sha256("\n".join(":".join(x) for x in lines).encode()).hexdigest()[:16]
    found = snapshot_hash(items.repartition(9))
    assert found.first().snapshot == f"sha256:{want}"
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    assert snapshot_hash(items.filter("false")).first().snapshot == f"sha256:{hashlib.sha256(b'').hexdigest()[:16]}"
