"""Blending of similarity, popularity and recency, and diversification."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.vectors import NEUTRAL, minmax_norm, rank_norm, recency_decay
from tessaline.operators.search import top_k


@dataclass(frozen=True)
class RerankConfig:
    weight_similarity: float = 0.7
    weight_popularity: float = 0.2
    weight_recency: float = 0.1
    half_life_days: float = 90.0
    multiplier: int = 4  # candidates for each result
    mmr: bool = False
    mmr_lambda: float = 0.7
    mmr_min_k: int = 10
    mmr_window: int = 50

    def __post_init__(self):
        weights = (self.weight_similarity, self.weight_popularity, self.weight_recency)
        if not all(0 <= x <= 1 for x in (*weights, self.mmr_lambda)):  # a number that is none fails too
            raise ValueError("weights and lambda must lie in 0..1")
        if abs(sum(weights) - 1) > 1e-6:
            raise ValueError("the weights must sum to 1")
        if not self.half_life_days > 0:
            raise ValueError("the half-life must be positive")
        if min(self.multiplier, self.mmr_window, self.mmr_min_k) < 1:
            raise ValueError("multiplier, window and least k must be 1 or more")

    @classmethod
    def from_hot(cls, section: dict) -> RerankConfig:
        """From the section of the hot configuration."""
        return cls(section["w_sim"], section["w_pop"], section["w_rec"], float(section["recency_half_life_days"]), section["candidate_multiplier"], section["enable_mmr"], section["mmr_lambda"], section["mmr_min_k"], section["mmr_window"])


def candidates(found: DataFrame, popularity: DataFrame, ages: DataFrame) -> DataFrame:
    """Search results with popularity and age_days; an item without either gets 0."""
    joined = found.join(popularity, "item_id", "left").join(ages, "item_id", "left")
    return joined.withColumn("popularity", F.coalesce("popularity", F.lit(0.0))).withColumn("age_days", F.coalesce("age_days", F.lit(0.0)))


def valid_candidate() -> Column:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (F.length("item_id") > 0) & finite("score") & finite("popularity") & finite("age_days") & (F.col("age_days") >= 0)


def blend(rows: DataFrame, config: RerankConfig, missing: tuple[str, ...] = ()) -> DataFrame:
    """rows with blend: the weighted sum of min-max similarity, rank-normalised popularity and recency decay. A missing signal counts 0.5 for all."""
    signals = {
        "similarity": minmax_norm(F.col("score"), "query_id"),
        "popularity": rank_norm(F.col("popularity"), "query_id"),
        "recency": recency_decay(F.col("age_days"), config.half_life_days),
    }
    parts = [F.lit(getattr(config, f"weight_{name}")) * (F.lit(NEUTRAL) if name in missing else value) for name, value in signals.items()]
    return rows.withColumn("blend", F.round(parts[0] + parts[1] + parts[2], 6))


def mmr_status(rows: DataFrame, requests: DataFrame, config: RerankConfig) -> DataFrame:
    """(query_id, status) of (query_id, k): disabled, no_candidates, k_below_min, no_vectors or applied, the first that holds."""
    have = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count("vector").alias("vectors"))
    status = F.when(~F.lit(config.mmr), "disabled").when(F.coalesce("n", F.lit(0)) == 0, "no_candidates").when(F.col("k") < config.mmr_min_k, "k_below_min").when(F.col("vectors") < F.col("n"), "no_vectors").otherwise("applied")
    return requests.join(have, "query_id", "left").select("query_id", status.alias("status"))


def mmr(rows: DataFrame, k: int, config: RerankConfig) -> DataFrame:
    """(query_id, item_id, blend, rank): greedy choice of lambda * blend - (1 - lambda) * greatest cosine with those chosen, within the first mmr_window by blend; the rest follow by blend. Scores stay blend scores."""
    by_blend = Window.partitionBy("query_id").orderBy(F.desc("blend"), "item_id")
    pool = rows.withColumn("place", F.row_number().over(by_blend)).select("query_id", "item_id", "blend", "vector", "place")
    pool = pool.filter(F.col("place") <= max(config.mmr_window, k))  # bounded groups
    window, lam = config.mmr_window, config.mmr_lambda

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place").reset_index(drop=True)
        head = group.iloc[:window]
        vectors = np.array(head["vector"].tolist(), dtype=np.float64)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        score, names = head["blend"].to_numpy(), head["item_id"].to_numpy()
        left, picked = list(range(len(head))), []
        nearest = np.full(len(head), -np.inf)
        while left and len(picked) < k:
            value = {i: round(lam * score[i] - (1 - lam) * (nearest[i] if picked else 0.0), 9) for i in left}
            best = min(left, key=lambda i: (-value[i], names[i]))
            left.remove(best)
            picked.append(best)
            nearest = np.maximum(nearest, vectors @ vectors[best])
        order = [*picked, *sorted(left), *range(len(head), len(group))][:k]
        out = group.iloc[order][["query_id", "item_id", "blend"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return pool.groupBy("query_id").applyInPandas(choose, "query_id string, item_id string, blend double, rank int")


class Reranker(Protocol):
    """Candidates with their signals to at most k rows a query (query_id, item_id, score, rank), in a total order, without a state of its own."""

    def __call__(self, rows: DataFrame, k: int, config: RerankConfig, missing: tuple[str, ...] = ()) -> DataFrame: ...


def by_blend(rows: DataFrame, k: int, config: RerankConfig, missing: tuple[str, ...] = ()) -> DataFrame:
    """The best k by the blend of signals."""
    return top_k(blend(rows, config, missing).select("query_id", "item_id", F.col("blend").alias("score")), k)


def by_diversity(rows: DataFrame, k: int, config: RerankConfig, missing: tuple[str, ...] = ()) -> DataFrame:
    """k rows chosen one by one, with the scores of the blend."""
    return mmr(blend(rows, config, missing), k, config).select("query_id", "item_id", F.col("blend").alias("score"), "rank")


def reranker(config: RerankConfig, k: int) -> Reranker:
    """What a configuration asks for at k results."""
    return by_diversity if config.mmr and k >= config.mmr_min_k else by_blend


def renumber(ranked: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by rank, ranked again from 1."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
