"""Connected components of links, on executors only.

Alternating large-star and small-star rounds: each is one map-side combined minimum per
node and one join that adaptive execution can split where a node has very many links.
Every round's links are cut from their lineage in the shared checkpoint folder. The
rounds end when the links no longer change; they then form stars around the smallest
node of each component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import cut


def _least(links: DataFrame, key: str, value: str) -> DataFrame:
    return links.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "u", "v").select("k", F.least("m", "k").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links, "u", "v")
    moved = links.join(least, F.col("u") == F.col("k")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable."""
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    links = cut(links)
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state or not now[0]:
            break
        state = now
        links = cut(_small_star(_large_star(links)))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0 to n-1, the smallest node of each one's component under the links a-b and what roots holds already."""
    roots = np.arange(n) if roots is None else roots
    while len(a):
        x, y = roots[a], roots[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots = up
    return roots
