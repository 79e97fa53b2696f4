"""Drift on components and churn against numpy, plain Python and SQL over stored scores."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.operators import churn, drift, statistics


def vectors(spark, x, period):
    return spark.createDataFrame([(int(p), v.tolist()) for p, v in zip(period, x, strict=True)] + [(0, None)], "period int, v array<double>").repartition(4)


def made(seed=0, n=1200, dim=6, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.array([5, 3, 2, 1, 0.5, 0.1]) + 1e6  # far from zero
    period = np.arange(n) % 2
    x[period == 1, 1] += shift
    return x, period


def plain_psi(a, b, bins=10):
    edges = np.quantile(a, [i / bins for i in range(1, bins)])
    p, q = (np.maximum(np.bincount(np.searchsorted(edges, s, side="right"), minlength=bins) / len(s), 1e-4) for s in (a, b))
    return float(((q - p) * np.log(q / p)).sum())


def test_moments_and_components_equal_numpy(spark):
    x, period = made()
    found = drift.moments(vectors(spark, x, period), "v")
    assert found.n == len(x) and np.allclose(found.mean, x.mean(axis=0)) and np.allclose(found.covariance, np.cov(x.T), rtol=1e-7, atol=1e-7)
    axes = drift.components(found, 3)
    right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    assert np.allclose(np.abs((axes * right).sum(axis=1)), 1, atol=1e-6)
    assert (axes[np.arange(3), np.abs(axes).argmax(axis=1)] > 0).all()


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_drift_equals_numpy(spark, shift):
    x, period = made(1, shift=shift)
    got = {r.component: r.psi for r in drift.component_drift(vectors(spark, x, period), "period", "v", 3).collect()}
    own = x[period == 0]
    axes = drift.components(drift.Moments(len(own), own.mean(axis=0), np.cov(own.T)), 3)
    scores = (x - own.mean(axis=0)) @ axes.T
    want = {i + 1: plain_psi(scores[period == 0, i], scores[period == 1, i]) for i in range(3)}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert (got[2] > 1) == (shift > 0) and got[1] < 0.2


def test_drift_without_rows(spark):
    x, period = made(2, n=20)
    rows = vectors(spark, x, period)
    assert drift.component_drift(rows.filter("period = 1"), "period", "v").collect() == []
    only = {r.component: r.psi for r in drift.component_drift(rows.filter("period = 0"), "period", "v", 2).collect()}
    assert set(only) == {1, 2} and all(p > 1 for p in only.values())  # nothing now: every share falls to the least


def log(spark, users=300, seed=3):
    """Users who slow down and leave, others who stay."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        leaves = 8 + 25 * rng.random() if u % 2 else 99
        day = rng.random()
        while day < min(30, leaves):
            rows.append((u, datetime(2024, 1, 1) + timedelta(days=day), "view" if rng.random() < 0.8 else "buy", float(rng.random())))
            day += rng.exponential(0.5)
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, kind string, value double"), rows


CUTOFFS = {"train": [datetime(2024, 1, 12), datetime(2024, 1, 15)], "validation": [datetime(2024, 1, 20)], "test": [datetime(2024, 1, 26)]}


def test_examples_see_only_what_precedes_the_cutoff(spark):
    events, rows = log(spark, 40)
    cutoff = datetime(2024, 1, 15)
    got = {r.user_id: r for r in churn.examples(events, cutoff, 10, 48).collect()}
    for u in range(40):
        before = [r for r in rows if r[0] == u and cutoff - timedelta(days=10) <= r[1] < cutoff]
        after = [r for r in rows if r[0] == u and cutoff <= r[1] < cutoff + timedelta(hours=48)]
        assert (u in got) == bool(before)
        if before:
            r, late = got[u], sum(x[1] >= cutoff - timedelta(days=5) for x in before)
            assert r.events == len(before) and r.label == (not after) and r.kinds == len({x[2] for x in before}) and r.active_days == len({x[1].date() for x in before})
            assert r.recency_days == pytest.approx((cutoff - max(x[1] for x in before)).total_seconds() / 86400) and r.trend == pytest.approx((2 * late - len(before)) / len(before))


def test_splits_must_not_leak(spark):
    events, _ = log(spark, 5)
    with pytest.raises(ValueError, match="horizon"):
        churn.split_by_time(events, CUTOFFS, 10, 24 * 7)
    with pytest.raises(ValueError):
        churn.split_by_time(events, CUTOFFS | {"test": [datetime(2024, 1, 19)]}, 10, 24)


def test_metrics_come_from_unseen_time_and_equal_sql(spark, tmp_path):
    events, _ = log(spark)
    scores = churn.fit_and_score(churn.split_by_time(events, CUTOFFS, 10, 48))
    assert {r.split for r in scores.select("split").distinct().collect()} == {"validation", "test"}
    scores.write.parquet(str(tmp_path / "scores"))
    rows = {(r.model, r.split): r for r in churn.evaluate(scores).collect()}
    sql = duckdb.sql(f"""WITH s AS (FROM '{tmp_path}/scores/*.parquet') SELECT a.model, a.split, n, positives, brier, auc FROM
      (SELECT model, split, count(*) AS n, sum(label) AS positives, avg((score - label) ** 2) AS brier FROM s GROUP BY ALL) a JOIN
      (SELECT x.model, x.split, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS auc FROM s x JOIN s y ON x.model = y.model AND x.split = y.split AND x.label = 1 AND y.label = 0 GROUP BY ALL) b USING (model, split)""").fetchall()
    assert len(sql) == len(rows) == 4
    for model, split, n, positives, brier, auc in sql:
        r = rows[model, split]
        assert (r.n, r.positives) == (n, positives) and r.brier == pytest.approx(brier) and r.auc == pytest.approx(auc)
    best = max(("boosted_trees", "logistic"), key=lambda m: rows[m, "validation"].auc)
    assert {m for (m, _), r in rows.items() if r.chosen} == {best} and rows[best, "test"].auc > 0.75
    bins = churn.reliability(scores, churn.evaluate(scores)).collect()
    assert sum(r.n for r in bins) == rows[best, "test"].n


def test_one_class_has_no_model(spark):
    events = spark.createDataFrame([(u, datetime(2024, 1, d), "view", 1.0) for u in range(4) for d in range(1, 31)], "user_id long, ts timestamp_ntz, kind string, value double")
    scores = churn.fit_and_score(churn.split_by_time(events, CUTOFFS, 10, 24))
    assert scores.collect() == [] == churn.evaluate(scores).collect()


def test_area_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(s), int(y)) for s, y in zip(rng.integers(0, 30, 500) / 30, rng.integers(0, 2, 500), strict=True)] + [("b", 0.1, 1), ("b", 0.2, 1)]
    got = {r.g: r.auc for r in statistics.area_under_curve(spark.createDataFrame(rows, "g string, score double, label int"), "g").collect()}
    ones, zeros = ([s for g, s, y in rows if g == "a" and y == k] for k in (1, 0))
    want = np.mean([(p > q) + 0.5 * (p == q) for p in ones for q in zeros])
    assert got == {"a": pytest.approx(want), "b": None}
    alone = statistics.area_under_curve(spark.createDataFrame(rows, "g string, score double, label int").filter(F.col("g") == "a")).first()
    assert alone.auc == pytest.approx(want)


def test_t_distribution():
    """Against known values, and against the integral of the density."""
    import math

    assert statistics.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and statistics.t_border(0.95, 10) == pytest.approx(2.228139, abs=1e-5)
    assert statistics.t_border(0.99, 1e7) == pytest.approx(2.575829, abs=1e-5) and statistics.t_tail(0.0, 3.3) == 1.0
    for df in (1.0, 2.5, 17.3, 400.0):
        for t in (0.1, 0.8, 2.0, 6.0):
            x = np.linspace(0, t, 200_001)
            density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
            assert statistics.t_tail(t, df) == statistics.t_tail(-t, df) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)


def test_welch_interval(spark):
    rows = [(0, float(x)) for x in (1, 2, 3, 4, 5)] + [(1, float(x)) for x in (2, 4, 6, 8)]
    r = statistics.welch(spark.createDataFrame(rows, "arm int, v double"), "arm", "v").first()
    assert r.difference == 2.0 and r.low < 0 < r.high and r.high - 2.0 == pytest.approx(2.0 - r.low)
    assert r.p_value == pytest.approx(statistics.t_tail(r.t, r.df)) and r.p_value > 0.05
    assert statistics.welch(spark.createDataFrame(rows[:6], "arm int, v double"), "arm", "v").collect() == []
    same = statistics.welch(spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "arm int, v double"), "arm", "v").first()
    assert (same.t, same.p_value, same.low) == (None, None, None)
