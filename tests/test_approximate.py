"""Graph index, stored cells, filtered rounds, benchmark and exact percentiles."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.operators import ann, events, graph_index, percentiles, search, statistics, sweep

SCHEMA = "item_id string, vector array<double>, brand string, category string, language string"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, dim=16, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return unit(c[rng.integers(0, centres, n)] + 0.2 * rng.standard_normal((n, dim)))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{n:05d}", v.tolist(), f"b{n % 7}", "c", "en" if n % 2 else "fr") for n, v in enumerate(clustered(1500))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(items):
    return items.filter("item_id < 'i00060'").select(F.col("item_id").alias("query_id"), "vector").cache()


@pytest.fixture(scope="module")
def graph(items, tmp_path_factory):
    return graph_index.build(items, str(tmp_path_factory.mktemp("g") / "graph"), m=6, ef_construction=24, shard_rows=600)


@pytest.fixture(scope="module")
def cells(items, tmp_path_factory):
    return ann.store(items, str(tmp_path_factory.mktemp("c") / "cells"), ann.fit(items, 5))


def pairs(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


def ranked(df):
    return sorted((r.query_id, r.item_id, round(r.score, 6), r["rank"]) for r in df.collect())


def test_recall_of_the_graph_rises_with_ef(items, asked, graph):
    exact = pairs(search.search(asked, items, 10))
    recall = [len(pairs(graph_index.search(asked, graph, 10, ef)) & exact) / len(exact) for ef in (10, 30, 600)]
    assert recall[0] <= recall[1] <= recall[2] and recall[1] >= 0.9 and recall[2] == 1.0
    assert graph.count() == 3


def test_links_stay_in_the_shard_and_reach_every_row(graph):
    links = graph_index.adjacency(graph).toPandas()
    degree = links[links.layer == 0].groupby("item_id").size()
    assert degree.max() <= 12 + 3 and set(links.layer) >= {0, 1}  # twice m, and the rows that hang from one
    for row in graph.collect():
        base = graph_index.graph_of(row.asDict(recursive=True)).layers[0]
        reached, todo = {0}, [0]
        while todo:
            for j in base[todo.pop()]:
                if j >= 0 and j not in reached:
                    reached.add(int(j))
                    todo.append(int(j))
        assert len(reached) == len(row.ids)


class Counted:
    """Links that count how often they are asked."""

    def __init__(self, links):
        self.links, self.asked = links, 0

    def __len__(self):
        return len(self.links)

    def __getitem__(self, at):
        self.asked += 1
        return self.links[at]


def test_a_walk_takes_few_steps_and_finds_what_comparing_finds():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 32))
    _, graph = graph_index.build_graph(vectors, rng.random(3000), 16, 64)
    counted = graph_index.Graph(graph.vectors, [Counted(graph.layers[0]), *graph.layers[1:]])
    queries = graph.vectors[:30].astype(np.float64)
    for asked in (queries, queries[:1]):
        counted.layers[0].asked = 0
        found, sims = graph_index.walk(counted, asked, 320)
        assert counted.layers[0].asked < 40  # one candidate at a time: 320 and more
        assert all(len(set(row)) == 320 for row in found.tolist()) and (np.diff(sims, axis=1) <= 0).all()
        best = np.argsort(-(asked @ graph.vectors.T.astype(np.float64)), axis=1)[:, :10]
        assert (found[:, :10] == best).mean() > 0.99


def test_equal_vectors_and_small_tables(spark, tmp_path):
    same = spark.createDataFrame([(f"s{n:03d}", [1.0, 0.0]) for n in range(200)] + [("far", [0.0, 1.0]), ("none", None)], "item_id string, vector array<double>")
    index = graph_index.build(same, str(tmp_path / "a"), m=3, ef_construction=5, shard_rows=1000)
    query = spark.createDataFrame([("q", [0.0, 1.0]), ("p", [1.0, 0.0])], "query_id string, vector array<double>")
    found = ranked(graph_index.search(query, index, 3, 8))
    assert ("q", "far", 1.0, 1) in found and len(found) == 6
    empty = graph_index.build(same.filter("false"), str(tmp_path / "b"))
    assert graph_index.search(query, empty, 3).collect() == []
    one = graph_index.build(same.filter("item_id = 'far'"), str(tmp_path / "c"))
    assert ranked(graph_index.search(query, one, 3)) == [("p", "far", 0.0, 1), ("q", "far", 1.0, 1)]
    with pytest.raises(ValueError):
        graph_index.search(query, one, 0)


def test_rounds_are_exact_under_any_filter(items, asked, cells):
    for filters in (None, {"brand": "b3"}, {"brand": "b1", "language": "fr"}, {"brand": "absent"}):
        want = ranked(search.search(asked, items, 7, filters))
        assert ranked(ann.search_rounds(asked, cells, 7, filters, max_rows=1 << 40, first=1)) == want


def test_rounds_stop_at_the_limit_of_rows(items, asked, cells, monkeypatch):
    read = []
    whole = ann.Stored.read
    monkeypatch.setattr(ann.Stored, "read", lambda self, spark, cells, predicate=None: read.append(cells) or whole(self, spark, cells, predicate))
    few = ann.search_rounds(asked.limit(1), cells, 1400, None, max_rows=100, first=1)
    scanned = cells.rows[sorted({c for r in read for c in r})].sum()
    assert few.count() == scanned >= 100
    assert scanned - max(cells.rows) < 100  # the last cell may run over
    read.clear()
    ann.search_rounds(asked.limit(1), cells, 5, None, first=1).collect()
    assert len({c for r in read for c in r}) < len(np.flatnonzero(cells.rows))  # clusters end the search


def test_filters_prune_partitions_and_reach_the_scan(spark, cells):
    out = io.StringIO()
    with redirect_stdout(out):
        cells.read(spark, [1, 3], search.filter_predicate({"brand": "b1"})).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [cell" in plan and "IN (1,3)" in plan and "EqualTo(brand,b1)" in plan


def test_sweep_has_a_row_for_each_knob(items, asked, graph):
    rows = {r.ef: r for r in sweep.sweep(asked, graph, 10, search.search(asked, items, 10), (12, 48), warm_up=2).collect()}
    assert set(rows) == {None, 12, 48}
    exact = pairs(search.search(asked, items, 10))
    for ef in (12, 48):
        assert rows[ef].recall == pytest.approx(len(pairs(graph_index.search(asked, graph, 10, ef)) & exact) / len(exact), abs=1e-6)
    assert rows[None].recall == 1.0 and rows[None].system == "exact"
    assert all(r.queries == 60 and 0 < r.p50_ms <= r.p95_ms <= r.p99_ms and r.queries_per_sec > 0 for r in rows.values())


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", 5.0)] * 3000 + [("wide", float(x)) for x in rng.normal(size=2000)] + [(None, 1.0), (None, 4.0), ("one", 2.5), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.fraction): r.value for r in percentiles.exact_percentiles(df, "v", fractions, "g").collect()}
    groups = {"hot": [5.0], "wide": [v for g, v in rows if g == "wide"], None: [1.0, 4.0], "one": [2.5]}
    assert got == {(g, f): pytest.approx(np.quantile(v, f)) for g, v in groups.items() for f in fractions}
    alone = {r.fraction: r.value for r in percentiles.exact_percentiles(df, "v", [0.5]).collect()}
    assert alone == {0.5: pytest.approx(np.median([v for _, v in rows if v is not None and v == v]))}
    assert percentiles.exact_percentiles(df.filter("false"), "v", [0.5], "g").collect() == []
    with pytest.raises(ValueError):
        percentiles.exact_percentiles(df, "v", [1.5])


def test_a_hot_value_is_spread(spark):
    df = spark.range(20000).select(F.lit("k").alias("g"), F.lit(1.0).alias("v"))
    seen = []
    whole = percentiles.cut
    percentiles.cut = lambda d: seen.append(whole(d)) or seen[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert percentiles.exact_percentiles(df, "v", [0.5], "g").first().value == 1.0
    finally:
        percentiles.cut = whole
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * 20000


def test_percentiles_of_latencies_and_guardrails(spark):
    rows = spark.createDataFrame([("a", float(i), i % 2 == 0) for i in range(101)] + [(None, 3.0, True), ("b", None, False)], "g string, v double, bad boolean")
    got = {r.g: (r.p50, r.p95, r.n) for r in events.latency_percentiles(rows, "v", "g").collect()}
    assert got == {"a": (50.0, 95.0, 101), None: (3.0, 3.0, 1), "b": (None, None, 1)}
    limits = {"error_rate": 0.6, "p95": 90.0}
    assert {r.g: (r.n, r.p95, r.breached) for r in statistics.guardrails(rows, "g", "bad", "v", limits).collect()} == {"a": (101, 95.0, True), None: (1, 3.0, True), "b": (1, None, None)}
