"""Search backends by name. A backend is opened once over its items, and then has one signature: (queries, items, k, filters) to (query_id, item_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators import ann, graph_index, search
from tessaline.session import shared_folder

Backend = Callable[[DataFrame, DataFrame, int, dict | None], DataFrame]
OVERFETCH = 4  # times k, of which a graph search keeps what matches a filter
EF = 100


def exact(queries: DataFrame, items: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
    return search.search(queries, items, k, filters)


def open_exact(items: DataFrame) -> Backend:
    return exact


def _indexed(items: DataFrame) -> DataFrame:
    return items.select("item_id", "vector", *[c for c in search.FILTER_FIELDS if c in items.columns])


def open_inverted_file(items: DataFrame) -> Backend:
    """Cells are fitted, assigned and stored once; every search, filtered or not, reads the cells that it probes, in rounds."""
    rows = _indexed(items)
    stored = ann.store(rows, shared_folder(items.sparkSession, "cells"), ann.fit(rows, 10))
    return lambda queries, _, k, filters=None: ann.search_rounds(queries, stored, k, filters)


def open_hnsw(items: DataFrame, ef: int = EF) -> Backend:
    """The graphs are built and stored once. Under a filter OVERFETCH times k rows are fetched, of which those that match are kept, so fewer than k may be left."""
    index = graph_index.build(items, shared_folder(items.sparkSession, "graph"))

    def run(queries: DataFrame, metadata: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
        predicate = search.filter_predicate(filters)
        if predicate is None:
            return graph_index.search(queries, index, k, ef)
        found = graph_index.search(queries, index, OVERFETCH * k, ef)
        kept = found.join(metadata.filter(predicate).select("item_id"), "item_id", "left_semi")
        return search.top_k(kept.drop("rank"), k).select("query_id", "item_id", "score", F.col("rank"))

    return run


BACKENDS: dict[str, Callable[[DataFrame], Backend]] = {"exact": open_exact, "inverted_file": open_inverted_file, "hnsw": open_hnsw}


def backend(name: str, items: DataFrame) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {sorted(BACKENDS)}")
    return BACKENDS[name](items)
