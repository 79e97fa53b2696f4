"""From requests to ranked items: query vectors, retrieval, signals, re-ranking, response."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.functions.encoder import Encoder, encode
from tessaline.functions.text import query_text
from tessaline.functions.vectors import mean_vectors, normalise
from tessaline.operators import providers, rerank
from tessaline.operators.backends import Backend, exact


def encoded_query_vectors(seeds: DataFrame, catalog: DataFrame, encoder: Encoder) -> DataFrame:
    """(query_id, vector): unit mean of the newly encoded texts of a query's seeds; seeds that the catalog lacks are skipped, a repeated one counts once."""
    found = seeds.select("query_id", "item_id").distinct().join(catalog.select("item_id", query_text(F.col("title"), F.col("description")).alias("text")), "item_id")
    vectors = found.select("query_id", encode(F.col("text"), encoder).alias("vector"))
    return mean_vectors(vectors, "query_id", "vector").select("query_id", normalise(F.col("vector")).alias("vector")).filter("vector IS NOT NULL")


@dataclass(frozen=True)
class Retrieval:
    """Candidates (query_id, item_id, score, popularity, age_days, vector) before re-ranking, which is what a cache keeps; the outcome of each request; signals that were unavailable."""

    candidates: DataFrame
    outcomes: DataFrame
    missing: tuple[str, ...] = ()


def retrieve(requests: DataFrame, vectors: DataFrame, items: DataFrame, k: int, config: rerank.RerankConfig, popularity: providers.Provider, recency: providers.Provider, filters: dict[str, str] | None = None, backend: Backend = exact) -> Retrieval:
    """k times config.multiplier candidates of each request (query_id, seeds) with a vector.

    A request without seeds has outcome empty_seeds, one without a vector all_seeds_missing, any other ok,
    also if its filters leave no item.
    """
    if k < 1:
        raise ValueError("k must be positive")
    known = vectors.select("query_id", F.lit(True).alias("known"))
    outcome = F.when(F.coalesce(F.size("seeds"), F.lit(0)) < 1, "empty_seeds").when(F.col("known").isNull(), "all_seeds_missing").otherwise("ok")
    outcomes = requests.select("query_id", "seeds").join(known, "query_id", "left").select("query_id", outcome.alias("outcome"))
    asked = vectors.join(outcomes.filter("outcome = 'ok'"), "query_id", "left_semi")
    found = backend(asked, items, k * config.multiplier, filters)
    ids = found.select("item_id").distinct()
    missing = []
    signals = {}
    for name, provider in (("popularity", popularity), ("recency", recency)):
        values = providers.fetch(provider, ids, per_query=k * config.multiplier)
        if values is None:
            missing.append(name)
            values = ids.limit(0).withColumn("value", F.lit(0.0))
        signals[name] = values
    rows = rerank.candidates(found, signals["popularity"].withColumnRenamed("value", "popularity"), signals["recency"].withColumnRenamed("value", "age_days"))
    return Retrieval(rows.join(items.select("item_id", "vector"), "item_id"), outcomes, tuple(missing))


def respond(retrieval: Retrieval, requests: DataFrame, k: int, config: rerank.RerankConfig) -> DataFrame:
    """(query_id, item_id, score, rank): re-ranked with room for the requests' seeds, which then go."""
    most = requests.agg(F.coalesce(F.max(F.size(F.array_distinct("seeds"))), F.lit(0)).alias("n")).first().n
    seeds = requests.select("query_id", F.explode("seeds").alias("item_id"))
    ranked = rerank.reranker(config, k)(retrieval.candidates, k + max(int(most), 0), config, retrieval.missing)
    kept = ranked.join(seeds, ["query_id", "item_id"], "left_anti")
    return rerank.renumber(kept, k).select("query_id", "item_id", "score", "rank")


def recommend(requests: DataFrame, vectors: DataFrame, items: DataFrame, k: int, config: rerank.RerankConfig, popularity: providers.Provider, recency: providers.Provider, filters: dict[str, str] | None = None, backend: Backend = exact) -> tuple[DataFrame, Retrieval]:
    """The response, and the retrieval behind it."""
    retrieval = retrieve(requests, vectors, items, k, config, popularity, recency, filters, backend)
    return respond(retrieval, requests, k, config), retrieval
