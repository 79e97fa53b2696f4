"""Hand-computed values and edge cases of the operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessaline.functions import hashing, text, vectors
from tessaline.operators import baselines, evaluation, events, experiments, lifecycle, rerank, search, statistics
from tessaline.sources import files
from tessaline.streaming import state


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hashes(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, hashing.hmac_sha256(key, F.lit("Ünïcode 7")))[0] == hmac.new(key, "Ünïcode 7".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        hashing.hmac_sha256(b"", F.lit("x"))
    for user in ("u1", "42", "é"):
        assert one(spark, hashing.bucket(F.lit("s"), F.lit(user)))[0] == int(hashlib.sha256(f"s:{user}".encode()).hexdigest(), 16) % 10_000
        assert one(spark, hashing.synthetic_popularity(F.lit(user)))[0] == int(hashlib.sha256(user.encode()).hexdigest()[:8], 16) % 1000
    assert one(spark, hashing.blake2b_128(F.lit("abc")))[0] == hashlib.blake2b(b"abc", digest_size=16).hexdigest()
    assert one(spark, hashing.credential_bucket(b"k", F.lit("   ")))[0] is None
    assert one(spark, hashing.credential_bucket(b"k", F.lit(" token ")))[0] == hmac.new(b"k", b"token", hashlib.sha256).hexdigest()[:32]
    assert one(spark, hashing.effective_salt(F.lit("prod"), F.lit("s"), F.lit("other")))[0] == "other:s"


def test_text(spark):
    title, description = " ｆｕｌｌ  width\t", "line two " + "x" * 600
    plain = lambda s: " ".join(unicodedata.normalize("NFKC", s).split())
    want = f"{plain(title)} | {plain(description)}"[:512].strip()
    assert one(spark, text.item_text(F.lit(title), F.lit(description)))[0] == want
    assert one(spark, text.item_text(F.lit("only"), F.lit("  ")))[0] == "only"
    assert one(spark, text.content_hash(F.lit(title), F.lit(description)))[0] == hashlib.sha256(want.encode()).hexdigest()[:16]
    assert one(spark, text.iso_timestamp(F.lit("2024-01-01T00:00:00")), text.iso_timestamp(F.lit("2024-01-01T00:00:00Z"))) == (None, dt.datetime(2024, 1, 1))
    assert one(spark, text.path_class(F.lit("/healthz")), text.path_class(F.lit("/v1/events/x"))) == (None, "events")
    assert one(spark, text.client_ip(F.lit("1.1.1.1, ::1"), F.lit("9.9.9.9"), 1), text.client_ip(F.lit(None).cast("string"), F.lit("?"), 1)) == ("::1", "unknown")


def test_normalisation_constants(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("b", 3.0), ("b", 3.0), ("c", 9.0)], "q string, v double")
    got = sorted(map(tuple, rows.select("q", "v", vectors.rank_norm(F.col("v"), "q"), vectors.minmax_norm(F.col("v"), "q")).collect()))
    assert [r[2] for r in got] == [0.0, 0.75, 0.75, 0.5, 0.5, 0.5]
    assert [r[3] for r in got][3:] == [0.5, 0.5, 0.5]
    assert one(spark, *[vectors.recency_decay(F.lit(float(d)), 90.0) for d in (0, 90, 180)]) == (1.0, 0.5, 0.25)
    assert one(spark, vectors.normalise(F.array(F.lit(0.0), F.lit(0.0))))[0] is None


def corpus(spark):
    rows = [("i_3", [1.0, 0.0, 0.0], "books", "ace", "en"), ("i_1", [1.0, 0.0, 0.0], "books", "tor", "en"), ("i_4", [0.0, 1.0, 0.0], "music", "blue", "en"), ("i_2", [-1.0, 0.0, 0.0], "music", None, "fr")]
    return spark.createDataFrame(rows, "item_id string, vector array<float>, category string, brand string, language string")


def test_search(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
    found = [tuple(r) for r in search.search(asked, corpus(spark), 4).orderBy("rank").collect()]
    assert found == [("q", "i_1", 1.0, 1), ("q", "i_3", 1.0, 2), ("q", "i_4", 0.0, 3), ("q", "i_2", 0.0, 4)]
    only = search.search(asked, corpus(spark), 9, {"category": "music", "brand": " "}).orderBy("rank").collect()
    assert [r.item_id for r in only] == ["i_4", "i_2"]
    assert search.search(asked, corpus(spark), 3, {"brand": "none"}).collect() == []
    assert search.search(asked.limit(0), corpus(spark), 3).collect() == []
    with pytest.raises(ValueError):
        search.search(asked, corpus(spark), 1, {"colour": "x"})
    with pytest.raises(ValueError):
        search.search(asked, corpus(spark), 0)
    with pytest.raises(TypeError):
        search.search(asked, corpus(spark), 1, {"brand": 3})


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("r", [0.0, 1.0, 0.0])], "query_id string, vector array<double>")
    got = {(r.query_id, r.item_id) for r in search.search(asked, corpus(spark), 1, exclude=spark.createDataFrame([("q", "i_1")], "query_id string, item_id string")).collect()}
    assert got == {("q", "i_3"), ("r", "i_4")}


def test_search_deals_queries_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "ITEM_BLOCK", 2)
    test_search(spark)


def test_search_rejects_vectors_that_are_no_queries(spark):
    for vector in ([2.0, 0.0, 0.0], [float("nan"), 0.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0], [], None):
        asked = spark.createDataFrame([("q", vector)], "query_id string, vector array<double>")
        with pytest.raises(Exception):  # noqa: B017
            search.search(asked, corpus(spark), 1).collect()


def test_search_of_many_queries_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((700, 8)), rng.standard_normal((60, 8))
    x[100:120] = x[0]
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    items = spark.createDataFrame([(f"i{n:03}", v.tolist()) for n, v in enumerate(x)], "item_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{n}", v.tolist()) for n, v in enumerate(q)], "query_id string, vector array<double>")
    hidden = spark.createDataFrame([(f"q{n}", f"i{i:03}") for n in range(60) for i in np.argsort(-(x @ q[n]))[: n % 4].tolist()], "query_id string, item_id string")
    skip = {tuple(r) for r in hidden.collect()}
    want = set()
    for n in range(60):
        scores = np.round(x @ q[n], 6)
        best = [i for i in sorted(range(700), key=lambda i: (-scores[i], i)) if (f"q{n}", f"i{i:03}") not in skip][:6]
        want |= {(f"q{n}", f"i{i:03}", rank + 1) for rank, i in enumerate(best)}
    assert {(r.query_id, r.item_id, r["rank"]) for r in search.search(asked, items, 6, exclude=hidden).collect()} == want


def test_mmr(spark):
    rows = spark.createDataFrame([("q", "i_a", 0.99, [1.0, 0.0]), ("q", "i_b", 0.98, [0.999, 0.01]), ("q", "i_c", 0.5, [0.0, 1.0])], "query_id string, item_id string, blend double, vector array<double>")
    order = lambda lam: [r.item_id for r in rerank.mmr(rows, 3, rerank.RerankConfig(mmr=True, mmr_lambda=lam, mmr_window=10)).orderBy("rank").collect()]
    assert order(0.5) == ["i_a", "i_c", "i_b"] and order(1.0) == ["i_a", "i_b", "i_c"]
    assert rerank.RerankConfig() == rerank.RerankConfig(mmr=False, mmr_min_k=10, multiplier=4)
    for bad in ({"weight_recency": 0.5}, {"weight_similarity": 1.2, "weight_popularity": -0.3}, {"mmr_lambda": 1.5}, {"mmr_lambda": float("nan")}, {"half_life_days": 0}, {"multiplier": 0}, {"mmr_window": 0}, {"mmr_min_k": 0}):
        with pytest.raises(ValueError):
            rerank.RerankConfig(**bad)


def test_metrics(spark):
    golden = spark.createDataFrame([("q", ["b", "c"]), ("none", []), ("miss", ["z"])], "query_id string, relevant array<string>")
    found = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("s", "q", "c", 12), ("s", "none", "a", 1), ("s", "miss", "a", 1)], "system string, query_id string, item_id string, rank int")
    got = {r.query_id: (r.recall, round(r.ndcg, 6), r.mrr) for r in evaluation.query_metrics(found, golden, 10).collect()}
    import math

    assert got == {"q": (0.5, round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6), 0.5), "none": (1.0, 0.0, 0.0), "miss": (0.0, 0.0, 0.0)}
    cut = lambda rows: spark.createDataFrame(rows, "query_id string, item_id string, rank int")
    f = {r.query_id: r.fidelity for r in evaluation.fidelity(cut([("q", "a", 1)]), cut([("q", "a", 1), ("q", "b", 2)]), golden, 2).collect()}
    assert f == {"q": 0.5, "none": 1.0, "miss": 1.0}


def test_gate_can_fail_twice(spark):
    values = spark.createDataFrame([("s", "recall", 0.1), ("s", "x", None), ("s", "y", float("nan")), ("i", "recall", 0.1), ("i", "missing_rate", 0.2)], "system string, metric string, value double")
    limits = [("s", "recall", "absolute_floor", 0.5), ("s", "recall", "per_system", 0.6), ("s", "x", "per_system", 1.0), ("s", "y", "per_system", 1.0), ("i", "recall", "per_system", 0.9), ("i", "missing_rate", "informational_floor", 0.1)]
    limits = spark.createDataFrame(limits, "system string, metric string, kind string, threshold double")
    header = spark.createDataFrame([("v1", "c", "2024-01-01T00:00:00Z")], "golden_set_version string, commit string, created_at string")
    run = lambda rules, informational=("i",): sorted((r.passed, r.reason, r.system, r.kind) for r in evaluation.gate(values, limits, header, rules, list(informational)).collect())
    assert run(evaluation.GateRules("v1")) == [(False, None, "i", "informational_floor"), (False, None, "s", "absolute_floor"), (False, None, "s", "per_system")]
    assert run(evaluation.GateRules("v1", required=("s", "t"))) == [(False, "missing: t", None, None)]
    assert run(evaluation.GateRules("v2")) == [(False, "golden_set_version", None, None)]
    assert run(evaluation.GateRules("v1", now="2024-01-02T00:00:01Z")) == [(False, "age", None, None)]
    empty = evaluation.gate(values, limits.limit(0), header, evaluation.GateRules("v1", "c", "2024-01-02T00:00:00Z", 24.0, ("s",)))
    assert [tuple(r)[:2] for r in empty.collect()] == [(True, None)]


def test_event_window_is_inclusive(spark):
    now = dt.datetime(2024, 1, 30)
    at = lambda s: F.lit(now + dt.timedelta(seconds=s))
    got = one(spark, *[events.in_window(at(s), F.lit(now)) for s in (-604_800, -604_801, 300, 301)])
    assert got == (True, False, True, False)


def test_insert_ignore_keeps_the_first(spark):
    batch = spark.createDataFrame([("e1", 2), ("e1", 1), ("e2", 3), ("e3", 4)], "event_id string, i int")
    stored = spark.createDataFrame([("e3",)], "event_id string")
    new = events.insert_ignore(stored, batch, "event_id", ["i"])
    assert sorted(map(tuple, new.collect())) == [("e1", 1), ("e2", 3)]
    assert tuple(events.accounting(batch, new).first()) == (2, 2, 0)


def test_assignment_precedence(spark):
    rows = spark.createDataFrame([("e", "s", "running", [("a", 100)]), ("p", "t", "paused", [("x", 50), ("y", 50)]), ("z", "w", "running", [("only", 1)])], "name string, salt string, status string, allocation array<struct<variant:string,pct:int>>")
    users = spark.createDataFrame([("1",), ("2",)], "user_id string")
    got = {(r.user_id, r.experiment): (r.variant, r.fallback_reason, r.log_exposure) for r in experiments.assign(users, rows, "dev").collect()}
    assert got["1", "e"] == ("a", None, True) and got["2", "p"] == ("x", "paused", True)
    assert got["1", "z"] == ("only", "allocation_gap", True)
    assert {r.fallback_reason for r in experiments.assign(users, rows, "dev", enabled=False).collect()} == {"disabled"}


def test_registry(spark):
    now = F.lit(dt.datetime(2024, 1, 2))
    rows = spark.createDataFrame([("a", "active", 5, dt.datetime(2024, 1, 1), None), ("b", "building", 3, None, None)], "index_version string, status string, row_count int, activated_at timestamp, retired_at timestamp")
    count = lambda n: spark.createDataFrame([("b", n)], "index_version string, stored long")
    status = lambda n: {r.index_version: r.status for r in lifecycle.promote(rows, "b", count(n), now).collect()}
    assert status(3) == {"a": "retired", "b": "active"}
    assert status(2) == {"a": "active", "b": "building"}
    assert {r.status for r in lifecycle.promote(rows, "a", count(3), now).collect()} == {"active", "building"}


def test_snapshot_scores(spark):
    items = spark.createDataFrame([(f"i{n}", "c", "b", "en" if n % 2 else "fr") for n in range(4)], "item_id string, category string, brand string, language string")
    snap = baselines.refresh_snapshot(items, 4)
    got = [(r["rank"], r.score) for r in baselines.read_snapshot(snap, 2).collect()]
    assert got == [(1, 0.8), (2, 0.6)]
    assert baselines.read_snapshot(snap.limit(0), 2).collect() == []


def test_snapshots_replace_one_another(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(LookupError):
        files.current_snapshot(spark, folder)
    for name, n in (("one", 3), ("two", 2)):
        files.replace_snapshot(spark.range(n), folder, name)
        assert files.current_snapshot(spark, folder).count() == n


def test_token_bucket(spark):
    log = spark.createDataFrame([("b", i, float(t), 1.0) for i, t in enumerate([0, 0, 0, 1, 2, 2])] + [("c", 9, 0.0, 5.0)], "bucket_id string, seq long, now double, cost double")
    got = {r.seq: (r.allowed, r.retry_after) for r in state.token_bucket(log, 2.0, 1.0).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 1), 3: (True, 0), 4: (True, 0), 5: (False, 1), 9: (False, 3)}


def test_breaker(spark):
    calls = spark.createDataFrame([("d", i, float(t), bool(f)) for i, (t, f) in enumerate([(0, 1), (1, 1), (2, 0), (12, 1), (20, 0), (33, 0), (34, 0)])], "name string, seq long, now double, failed boolean")
    got = [(r.state, r.admitted) for r in state.circuit_breaker(calls, 2, 10.0, 40.0).orderBy("seq").collect()]
    assert got == [("closed", True), ("closed", True), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]
    odd = spark.createDataFrame([("d", i, float(t), f) for i, (t, f) in enumerate([(0, True), (1, None), (2, True), (12, None), (13, False)])], "name string, seq long, now double, failed boolean")
    got = [(r.state, r.admitted) for r in state.circuit_breaker(odd, 2, 10.0, 40.0).orderBy("seq").collect()]
    assert got == [("closed", True), ("closed", True), ("closed", True), ("half_open", True), ("half_open", False)]


def test_two_tiers_and_cache(spark):
    log = spark.createDataFrame([(i, "ip", f"u{i % 2}", float(i), 1.0) for i in range(6)], "seq long, ip string, user string, now double, cost double")
    got = [(r.allowed, r.denied_by) for r in state.two_tiers(log, "ip", "user", (2.0, 0.0001)).orderBy("seq").collect()]
    assert got == [(True, None), (True, None)] + [(False, "ip")] * 4
    got = [(r.allowed, r.denied_by) for r in state.two_tiers(log, "ip", "user", (5.0, 0.0001), (1.0, 0.0001)).orderBy("seq").collect()]
    assert got == [(True, None), (True, None)] + [(False, "user")] * 3 + [(False, "ip")]
    replay = lambda backend, found: [r.outcome for r in state.cache_replay(log.select(F.lit("k").alias("key"), "seq", "now", backend.alias("backend"), found.alias("found")), 2.0, 3.0).orderBy("seq").collect()]
    assert replay(F.lit("ok"), F.lit("value")) == ["miss", "hit", "miss", "hit", "miss", "hit"]
    assert replay(F.lit("ok"), F.lit("nothing")) == ["miss", "negative", "negative", "miss", "negative", "negative"]
    assert replay(F.lit("ok"), F.lit("corrupt")) == ["miss"] + ["error"] * 2 + ["error"] * 3
    assert replay(F.when(F.col("seq") == 1, "open").when(F.col("seq") == 2, "down").otherwise("ok"), F.lit("value")) == ["miss", "bypass", "error", "miss", "hit", "miss"]


def test_stream_drops_repeats(spark, tmp_path):
    now = dt.datetime(2024, 1, 30)
    rows = [("e1", now), ("e1", now), ("e2", now - dt.timedelta(days=8)), ("e3", now)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id string, event_ts timestamp").coalesce(1).write.parquet(source)
    stream = state.ingest_stream(spark.readStream.schema("event_id string, event_ts timestamp").parquet(source), F.lit(now))
    query = stream.writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("ingested").collect()) == ["e1", "e3"]


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i + 1}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r.value.endswith(f" {r.line}") for r in rows)


def test_runs_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", [1.0, 0.0], "h", "v1"), ("a", [0.6, 0.8], "h", "v1"), ("a", [2.0, 0.0], "h", "v1"), ("c", [float("nan"), 0.0], "h", "v1"), ("d", [1.0], "h", "v1")], "item_id string, embedding array<float>, content_hash string, preprocessing_version string")
    bad = sorted(map(tuple, files.invalid_embeddings(rows, 2).collect()))
    assert bad == [("a", "norm"), ("a", "repeated"), ("c", "not finite"), ("d", "dimension")]
    files.write_run(rows, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run")).count() == 5
    path = tmp_path / "catalog.jsonl"
    path.write_text('{"item_id": "1", "title": "t", "description": "d", "category": "c", "brand": "b"}\n\n{oops\n')
    lines = files.read_lines(spark, str(path))
    assert [tuple(r) for r in files.catalog_errors(lines).collect()] == [(3, "not a JSON object")]
    assert files.parse_catalog(lines).count() == 1
    assert one(spark, files.version_of(F.lit("v12.jsonl")), files.version_of(F.lit("w.jsonl"))) == ("v12", None)
    values = spark.createDataFrame([("s", "mrr", 0.5)], "system string, metric string, value double")
    assert json.loads(files.report_json(values, commit="c"))["systems"] == {"s": {"metrics": {"mrr": 0.5}}}


def test_run_sources(spark, tmp_path):
    run = spark.createDataFrame([("b", [1.0, 0.0], "h", "v1"), ("a", [0.6, 0.8], "h", "v1")], "item_id string, embedding array<float>, content_hash string, preprocessing_version string")
    files.write_run(run, str(tmp_path / "run"), 2)
    with pytest.raises(ValueError):
        files.write_run(run.unionByName(run.limit(1)), str(tmp_path / "bad"), 2)
    assert not (tmp_path / "bad").exists()
    back = files.read_run(spark, str(tmp_path / "run"), spark.createDataFrame([("a", "x")], "item_id string, brand string"))
    assert sorted((r.item_id, r.brand) for r in back.collect()) == [("a", "x"), ("b", None)]
    assert files.previous_vectors(run, 2).count() == 2 and files.previous_vectors(run.limit(0), 3).collect() == []
    with pytest.raises(Exception):  # noqa: B017
        files.previous_vectors(run, 3).collect()
    files.write_run(run.limit(0), str(tmp_path / "empty"), 2)
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    values = spark.createDataFrame([("s", "mrr", 0.5)], "system string, metric string, value double")
    files.write_report(values, str(tmp_path / "report.json"), commit="c")
    assert json.loads((tmp_path / "report.json").read_text())["commit"] == "c"


def test_canonical_json(spark):
    rows = spark.createDataFrame([("é\"\\ 🙂 \n\t", 3, None), (None, None, "x"), ("", 0, "/ß")], "b string, a int, c string")
    got = [r.j for r in rows.select(hashing.canonical_json_column({c: F.col(c) for c in "cba"}).alias("j")).collect()]
    assert got == [hashing.canonical_json(r.asDict()) for r in rows.collect()]


def test_ids_and_ages(spark):
    assert one(spark, text.bounded_request_id(F.lit("x" * 100)))[0] == "x" * 64
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(vectors.recency_decay(F.lit(-1.0), 90.0)).collect()
    assert one(spark, text.strip(F.lit("\t\u00a0 a b \x1c\n")), text.collapse(F.lit("x\x1cy\u2003\u2003z"))) == ("a b", "x y z")
    assert one(spark, text.looks_like_ip(F.lit("a:" * 23)), text.looks_like_ip(F.lit("a:" * 22)))== (False, True)


def test_providers_and_serving(spark):
    from tessaline.operators import providers, serving

    items = corpus(spark).withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    ids = items.select("item_id")
    table = spark.createDataFrame([("i_1", 5.0)], "item_id string, value double")
    assert dict(map(tuple, providers.TableSignal(table).get(ids).collect())) == {"i_1": 5.0, "i_2": 0.0, "i_3": 0.0, "i_4": 0.0}
    assert dict(map(tuple, providers.TableSignal(table, None).get(ids).collect())) == {"i_1": 5.0}
    assert providers.SyntheticPopularity().get(ids).count() == 4
    assert providers.fetch(providers.Unavailable(), ids) is None and providers.fetch(providers.SyntheticPopularity(), ids, per_query=1001) is None
    broken = providers.TableSignal(table.withColumn("value", F.raise_error(F.lit("lost")).cast("double")))
    assert providers.fetch(broken, ids) is None  # only its execution fails
    assert providers.table_lookup(items)(ids.filter("item_id = 'i_1'")).count() == 1
    recency = providers.CreatedAtRecency(items, F.lit(dt.datetime(2024, 1, 3)))
    assert {r.value for r in recency.get(ids).collect()} == {2.0}
    requests = spark.createDataFrame([("q", ["i_3"]), ("e", []), ("u", ["nope"])], "query_id string, seeds array<string>")
    vectors_ = search.query_vectors(requests.select("query_id", F.explode("seeds").alias("item_id")), items)
    rows, retrieval = serving.recommend(requests, vectors_, items, 2, rerank.RerankConfig(), providers.TableSignal(table), providers.Unavailable())
    assert {r.query_id: r.outcome for r in retrieval.outcomes.collect()} == {"q": "ok", "e": "empty_seeds", "u": "all_seeds_missing"}
    assert retrieval.missing == ("recency",)
    assert [(r.item_id, r["rank"]) for r in rows.orderBy("rank").collect()] == [("i_1", 1), ("i_2", 2)]  # equal scores: by id
    none = serving.retrieve(requests, vectors_, items, 2, rerank.RerankConfig(), providers.TableSignal(table), recency, {"brand": "none"})
    assert none.candidates.collect() == [] and none.outcomes.filter("outcome = 'ok'").count() == 1


def test_cached_candidates(spark):
    from tessaline.operators import cache

    rows = spark.createDataFrame([("q", 'i"1', 0.5, 2.0, 1.0), ("q", "i2", 0.75, 0.0, 0.0)], "query_id string, item_id string, score double, popularity double, age_days double")
    value = cache.pack_candidates(rows)
    assert json.loads(value.first().value) == [["i2", 0.75, 0.0, 0.0], ['i"1', 0.5, 2.0, 1.0]]
    assert sorted(map(tuple, cache.unpack_candidates(value).collect())) == sorted(map(tuple, rows.collect()))
    bad = spark.createDataFrame([(str(i), v) for i, v in enumerate(['[["a",1.0,2.0]]', "{}", "[1]", "x", '[["a","b"]]', "[[null,1.0]]", "[]", '[["a",1.0]]'])], "query_id string, value string")
    assert [r.unreadable for r in cache.unpack_errors(bad).orderBy("query_id").collect()] == [True] * 6 + [False] * 2


def test_rollback_and_build(spark, tmp_path):
    from tessaline.operators import building

    now = F.lit(dt.datetime(2024, 1, 2))
    run = spark.createDataFrame([("b", [1.0, 0.0], "h", "v1"), ("a", [0.6, 0.8], "h", "v1")], "item_id string, embedding array<float>, content_hash string, preprocessing_version string")
    folder = str(tmp_path / "store")
    first, outcome = building.build_index(spark, folder, {"model_version": "m", "catalog_snapshot": "s1"}, run)
    assert outcome == "built" and building.build_index(spark, folder, {"model_version": "m", "catalog_snapshot": "s1"}, run) == (first, "duplicate")
    second, _ = building.build_index(spark, folder, {"model_version": "m", "catalog_snapshot": "s2"}, run.limit(1))
    status = lambda: {r.index_version: (r.status, r.row_count) for r in building.registry(spark, folder).collect()}
    assert status() == {first: ("building", 2), second: ("building", 1)}
    assert building.promote(spark, folder, first, now) == "promoted" and building.promote(spark, folder, second, now) == "promoted"
    assert status() == {first: ("retired", 2), second: ("active", 1)} and building.active_version(spark, folder) == second
    assert building.promote(spark, folder, second, now) == "already_active" and building.promote(spark, folder, "x", now) == "not_found"
    assert building.rollback(spark, folder, now) == (first, "promoted") and building.active_version(spark, folder) == first
    assert files.read_index(spark, f"{folder}/index", second).count() == 1


def test_chi_square_tail():
    import math

    for x in (0.1, 1.0, 5.0, 40.0):
        assert statistics.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2))
        assert statistics.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert statistics.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
    assert statistics.chi2_tail(0.0, 3) == 1.0


def test_statistics(spark):
    assert statistics.p_value(1.959964) == pytest.approx(0.05, abs=1e-6)
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "b", 0.02), ("g", "a", 0.02), ("h", "a", 0.05)], "family string, name string, p double")
    assert {(r.family, r.name): r.rejected for r in statistics.holm(rows, "family", "name", "p").collect()} == {("f", "a"): True, ("f", "c"): False, ("f", "b"): False, ("g", "a"): True, ("g", "b"): True, ("h", "a"): True}
    size = spark.range(1).select(statistics.sample_size(F.lit(0.1), F.lit(0.02)).alias("n"), statistics.sample_size(F.lit(0.99), F.lit(0.02)).alias("none")).first()
    assert (size.n, size.none) == (3839, None)
