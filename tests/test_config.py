"""Configuration sources, approximate search and the encoder."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.functions import encoder
from tessaline.operators import ann, search
from tessaline.sources import config

YAML = """
schema_version: 1   # comment
golden_set_version: "v1"
informational:
  - blend   # not gated
absolute_floor:
  exact_knn:
    recall: 0.7
    ndcg: null
exact_knn:
  mrr: 0.85
informational_floors:
  blend:
    missing_rate: 0.05
"""


def test_thresholds(spark):
    found = config.thresholds(config.parse_simple_yaml(YAML))
    assert set(found.rows) == {("exact_knn", "recall", "absolute_floor", 0.7), ("exact_knn", "mrr", "per_system", 0.85), ("blend", "missing_rate", "informational_floor", 0.05)}
    assert found.informational == {"blend"} and found.golden_set_version == "v1" and found.table(spark).count() == 3
    for old, new in (("  - blend", "  - exact_knn"), ("schema_version: 1", "schema_version: 2"), ('"v1"', '""'), ("mrr: 0.85", "mrr: high"), ("mrr: 0.85", "mrr: true"), ("  - blend   # not gated", "  blend: 1"), ("exact_knn:\n  mrr: 0.85\n", ""), ("absolute_floor:", "floor:")):
        with pytest.raises(ValueError):
            config.thresholds(config.parse_simple_yaml(YAML.replace(old, new)))
    with pytest.raises(ValueError):
        config.thresholds({})


EXPERIMENTS = """
schema_version: 1
experiments:
  - name: one
    salt: "s"
    status: stopped
    allocation:
      control: 50
      blend: 50
    started_at: "2024-01-01T00:00:00Z"
    stopped_at: "2024-02-01T00:00:00+01:00"
    description: >-
      Folded text: with a colon,
      # and what looks like a comment.

      Second paragraph.
"""


def test_experiments(spark):
    row = config.experiments(spark, config.parse_simple_yaml(EXPERIMENTS)).first()
    assert [tuple(a) for a in row.allocation] == [("control", 50), ("blend", 50)]
    assert row.description == "Folded text: with a colon, # and what looks like a comment.\nSecond paragraph."
    twice = EXPERIMENTS + EXPERIMENTS.split("experiments:\n")[1]
    for old, new in (("00Z", "00"), ("salt:", "colour:"), ("blend: 50", "blend: 51"), ("blend: 50", "blend: 50.0"), ("status: stopped", "status: running"), ("status: stopped", "status: off"), ("schema_version: 1", "schema_version: 2"), ("name: one", 'name: ""'), ("  - name", "  name")):
        with pytest.raises(ValueError):
            config.experiments(spark, config.parse_simple_yaml(EXPERIMENTS.replace(old, new)))
    with pytest.raises(ValueError):
        config.experiments(spark, config.parse_simple_yaml(twice))
    assert config.experiments(spark, config.parse_simple_yaml(twice.replace("name: one", "name: two", 1).replace('salt: "s"', 'salt: "t"', 1))).count() == 2


def test_simple_yaml():
    assert config.parse_simple_yaml("a: [1, x, 2.5]\nb:\n- 1\n- two\nc:\nd: 'x # y'\ne: |\n  one\n   two\n\nf: 1 # end") == {"a": [1, "x", 2.5], "b": [1, "two"], "c": None, "d": "x # y", "e": "one\n two\n", "f": 1}
    assert config.parse_simple_yaml("") == {} and config.parse_simple_yaml("- a: 1\n  b: 2\n- c") == [{"a": 1, "b": 2}, "c"]
    for bad in ("a: 1\na: 2", "a: 1\n   b: 2", "just text", "a: 1\n- b", "a:1"):
        with pytest.raises(ValueError):
            config.parse_simple_yaml(bad)


HOT = "schema_version: 1\nrate_limit:\n  recommend_per_minute: {limit}\n  events_per_minute: 6000\n  admin_per_minute: 60\nrerank:\n  w_sim: 0.7\n  w_pop: 0.2\n  w_rec: 0.1\n  mmr_lambda: 0.7\n  mmr_window: 50\n  mmr_min_k: 10\n  candidate_multiplier: 4\n  recency_half_life_days: 90\n  enable_mmr: {mmr}\ncache:\n  recommend_ttl_seconds: 300\n  similar_ttl_seconds: 600\n  negative_ttl_seconds: 30\n"


def test_hot_config_keeps_the_last_good_values(tmp_path):
    from tessaline.operators.rerank import RerankConfig

    path = tmp_path / "hot.yaml"
    hot = config.HotConfig(str(path))
    assert hot.refresh() == config.default_hot_values() and hot.error
    path.write_text(HOT.format(limit=5, mmr="true"))
    assert hot.refresh()["rate_limit"]["recommend_per_minute"] == 5 and hot.error is None
    assert hot.values == config.default_hot_values() | {"rate_limit": hot.values["rate_limit"], "rerank": config.default_hot_values()["rerank"] | {"enable_mmr": True}}
    assert RerankConfig.from_hot(hot.values["rerank"]) == RerankConfig(mmr=True)
    for number, bad in enumerate((HOT.format(limit=0, mmr="true"), HOT.format(limit=5, mmr=1), HOT.format(limit=5.5, mmr="true"), HOT.format(limit=5, mmr="true") + "api_key: x\n", HOT.format(limit=5, mmr="true").replace("w_sim", "w_x"), "schema_version: 1", "just text")):
        path.write_text(bad)
        os.utime(path, ns=(number, number))
        assert hot.refresh()["rate_limit"]["recommend_per_minute"] == 5 and hot.error, bad
    with pytest.raises(ValueError, match="secrets"):
        config.hot_values({"schema_version": 1, "cache": {"list": [{"My_Password": 1}]}})


def test_settings_and_identities():
    assert config.Settings.from_env({}).page_size == 10
    prod = {"ENVIRONMENT": "prod", "API_KEYS": "$argon2id$a,b; $argon2id$c", "JWT_SECRET": "j" * 32, "USER_HASH_SALT": "own", "DATABASE_URL": "postgresql://d", "CACHE_URL": "rediss://c"}
    env = lambda **changes: {f"TESSALINE_{k}": v for k, v in (prod | changes).items()}
    assert config.Settings.from_env(env()).keys == {"$argon2id$a,b", "$argon2id$c"}
    for bad in ({"API_KEYS": " "}, {"API_KEYS": "plain"}, {"JWT_SECRET": "short"}, {"JWT_SECRET": "change-me" + "x" * 40}, {"USER_HASH_SALT": "change-me-too"}, {"USER_HASH_SALT_VERSION": "0"}, {"DATABASE_URL": "sqlite://"}, {"CACHE_URL": "http://"}, {"ENVIRONMENT": "moon"}, {"JWT_ALGORITHM": "none"}, {"EXPERIMENT_ENVIRONMENT": "moon"}):
        with pytest.raises(ValueError):
            config.Settings.from_env(env(**bad))
    assert config.config_hash({"b": 1, "a": 2}) == config.config_hash({"a": 2, "b": 1})
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    first = config.run_id(now, "m", set())
    assert first == "2024-01-01T00-00-00Z__m" and config.run_id(now, "m", {first}) == "2024-01-01T00-00-00Z-01__m"
    version, known = config.resolve_collision("x", {})
    assert not known and config.resolve_collision("x", {version: "x"}) == (version, True)
    assert len(config.resolve_collision("x", {version: "other"})[0]) == len("idx-") + 12


def test_state_pointer_and_lock(tmp_path):
    expected = {"schema_version": 1, "model_version": "m"}
    assert config.state_problem(None, expected) == "missing"
    assert config.state_problem({"hashes": 1}, expected) == "malformed"
    assert config.state_problem({"hashes": {}, "schema_version": 1, "model_version": "n"}, expected) == "model_version"
    assert config.state_problem({"hashes": {}, **expected}, expected) is None
    assert config.read_pointer(str(tmp_path)) is None
    config.write_pointer(str(tmp_path), "run-1")
    config.write_pointer(str(tmp_path), "run-2")
    assert config.read_pointer(str(tmp_path)) == "run-2"
    lock, slept = str(tmp_path / "lock"), []
    with config.RunLock(lock):
        now = iter(range(100))
        with pytest.raises(TimeoutError), config.RunLock(lock, 3, 0.2, lambda: next(now), slept.append):
            pass
    assert slept == [0.2, 0.2]
    with config.RunLock(lock):
        pass


def test_committed_runs(tmp_path):
    folder = str(tmp_path)
    manifest = {"run_id": "r1", "model_version": "m", "preprocessing_version": "p", "catalog_snapshot": "s", "embedding_dim": 2, "row_count": 0}
    with pytest.raises(ValueError):
        config.resolve_run(folder)
    seen = []
    config.commit_run(folder, manifest, {"hashes": {}}, lambda path: seen.append((Path(path).name, config.read_pointer(folder))))
    assert seen == [("embeddings.parquet", None)] and config.resolve_run(folder)[1] == manifest

    def fails(path):
        raise OSError("full")

    with pytest.raises(OSError):
        config.commit_run(folder, {**manifest, "run_id": "r2"}, {"hashes": {}}, fails)
    assert config.read_pointer(folder) == "r1" and not (tmp_path / "r2" / "manifest.json").exists()
    with pytest.raises(ValueError):
        config.commit_run(folder, manifest, {}, seen.append)
    for bad in ({"row_count": -1}, {"row_count": "7"}, {"row_count": True}, {"model_version": ""}, {"embedding_dim": None}):
        assert config.manifest_problem(manifest | bad)
    assert config.manifest_problem([]) and config.manifest_problem(manifest) is None
    answers = iter(["v1", None, OSError("away"), "v2"])

    def read():
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    active = config.ActiveIndex(read)
    assert [active.refresh() for _ in range(4)] == ["v1", "v1", "v1", "v2"]


def test_encoder(spark):
    model = encoder.HashingEncoder(16)
    rows = spark.createDataFrame([("a b",), ("A B",), (None,), ("",)], "t string").select(encoder.encode(F.col("t"), model).alias("v")).collect()
    vectors = np.array([r.v for r in rows])
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1) and (vectors[0] == vectors[1]).all() and (vectors[2] == vectors[3]).all()
    assert model.encode([]).shape == (0, 16)


def test_approximate_search_reads_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 600)] + 0.1 * rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(f"i{n}", v.tolist()) for n, v in enumerate(x)], "item_id string, vector array<double>")
    cells = ann.fit(items, 5)
    assert cells.probes < len(cells.centroids)
    asked = items.limit(30).select(F.col("item_id").alias("query_id"), "vector")
    found = {(r.query_id, r.item_id) for r in ann.search(asked, ann.assign_cells(items, cells), cells, 5).collect()}
    exact = {(r.query_id, r.item_id) for r in search.search(asked, items, 5).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_plans_push_filters_and_prune_columns(spark):
    import io
    from contextlib import redirect_stdout

    from tessaline.plans.activity import ext_retention

    out = io.StringIO()
    with redirect_stdout(out):
        ext_retention(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = out.getvalue()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_search_filters_reach_the_scan(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    path = str(tmp_path / "items")
    rows = [(f"i{n}", [1.0, 0.0], "books", "ace", "en", "text that is not read") for n in range(9)]
    spark.createDataFrame(rows, "item_id string, vector array<float>, category string, brand string, language string, text string").write.parquet(path)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    out = io.StringIO()
    with redirect_stdout(out):
        search.search(asked, spark.read.parquet(path), 3, {"brand": " ace ", "language": "en"}).explain("formatted")
    plan = out.getvalue()
    assert "EqualTo(brand,ace)" in plan and "EqualTo(language,en)" in plan
    assert "ReadSchema: struct<item_id:string,vector:array<float>,brand:string,language:string>" in plan


def test_backends_agree_on_a_filter(spark):
    from tessaline.operators.backends import backend

    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(f"i{n}", v.tolist(), "en" if n % 2 else "fr", "b", "c") for n, v in enumerate(x)], "item_id string, vector array<double>, language string, brand string, category string")
    asked = items.limit(5).select(F.col("item_id").alias("query_id"), "vector")
    got = {name: {(r.query_id, r.item_id) for r in backend(name, items)(asked, items, 3, {"language": "en"}).collect()} for name in ("exact", "inverted_file", "hnsw")}
    assert got["exact"] == got["inverted_file"] and len(got["exact"]) == 15
    assert len(got["exact"] & got["hnsw"]) >= 0.6 * len(got["exact"])  # 12 rows fetched, of which half match
    with pytest.raises(ValueError):
        backend("graph", items)


def test_files_and_keys(spark, tmp_path):
    import hashlib

    from tessaline.functions import hashing
    from tessaline.sources import files

    (tmp_path / "model.bin").write_bytes(b"weights")
    assert files.file_hashes(spark, str(tmp_path / "model.bin")).first().sha256 == hashlib.sha256(b"weights").hexdigest()
    counters = spark.createDataFrame([("a\"b", 3)], "route string, n long")
    assert files.exposition(counters, "requests_total", "n", ["route"]).first().line == 'requests_total{route="a\\"b"} 3'
    assert files.render_table([{"a": 1}], ["a", "b"]).splitlines()[-1] == "| 1 | n/a |"
    run = spark.createDataFrame([("i1", 1)], "item_id string, n int")
    for version, n in (("v1", 1), ("v2", 2), ("v1", 3)):
        files.write_index(run.withColumn("n", F.lit(n)), str(tmp_path / "index"), version)
    assert [files.read_index(spark, str(tmp_path / "index"), v).first().n for v in ("v1", "v2")] == [3, 2]
    key = spark.range(1).select(hashing.cache_key("similar", F.lit("{}"), F.lit("x")), hashing.jittered_ttl(F.lit(100), F.lit(0.0)), hashing.jittered_ttl(F.lit(1), F.lit(0.0))).first()
    assert key[0] == f"cache:v1:similar:{hashlib.blake2b(b'{}', digest_size=16).hexdigest()}:x" and key[1:] == (90, 1)
