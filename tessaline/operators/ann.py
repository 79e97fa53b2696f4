"""Approximate search by an inverted file: cells around centroids, and the cells nearest to a query.

Centroids are fitted on a bounded sample (SAMPLE rows by the least hash of their id); every row is
indexed. The number of probed cells is raised until the recall against exact search, measured with rows of
the sample that are left out of the fit and of what is searched, reaches a target. The cell is a column to partition the stored index by, so
that a search reads only the cells it probes. As their number follows the sample, cells grow with the table; they are
therefore searched in parts of about PART rows, which each query visits.

``store`` writes the index once, with the columns that filters name; ``search_rounds`` searches it in strict order under
any filter. A cell's rows lie within an angle of its centroid, which bounds their scores; each query probes its cells by
falling bound, more of them in each round, until the k-th row that matches scores above the bound of
the next cell, or max_rows rows have been scanned. Short of that limit the result is exact. Each round reads the
partitions of its cells and pushes the filter into their scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.functions.vectors import clamp
from tessaline.operators.search import DIGITS, filter_predicate, top_k
from tessaline.session import cut

SAMPLE, ROUNDS, SEED, PART, QUERIES = 20_000, 8, 5, 50_000, 1024
MAX_ROWS = 20_000  # that a filtered search scans for a query


@dataclass
class Cells:
    centroids: np.ndarray
    probes: int
    parts: int = 1  # of each cell


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(items: DataFrame, k: int, target: float = 0.95, cells: int | None = None, queries: int = 100) -> Cells:
    """Centroids by spherical k-means on the sample, and the fewest probes that reach the target recall at k there."""
    sample = items.select("item_id", "vector").orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).toArrow()
    x = _matrix(sample.column("vector").combine_chunks())
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    held_out = np.arange(len(x)) % max(2, len(x) // queries) == 1
    asked, x = x[held_out], x[~held_out]
    if not len(x):
        return Cells(np.zeros((1, 0)), 1)
    cells = min(cells or max(1, int(np.sqrt(len(x)))), len(x))
    centroids = x[np.random.default_rng(SEED).choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        for c in range(cells):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    own = np.argmax(x @ centroids.T, axis=1)
    exact = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    nearest = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.argsort(nearest, axis=1)  # how many probes until a cell is read
    needed = np.take_along_axis(place, own[exact], axis=1)
    probes = next((p for p in range(1, cells + 1) if (needed < p).mean() >= target), cells)
    return Cells(centroids, probes, max(1, -(-items.count() // (cells * PART))))


def assign_cells(items: DataFrame, cells: Cells) -> DataFrame:
    """items with their cell."""
    names = items.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(_matrix(batch.column(at)) @ cells.centroids.T, axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*names, "cell"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(run, f"{kept}, cell int")


def search(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, item_id, score, rank) of the best k in the probed cells. Queries (a bounded set) meet a cell's rows by a join on the cell."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(_matrix(batch.column(1)) @ cells.centroids.T), axis=1)[:, : cells.probes]
            row = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(near.ravel().astype(np.int32))], ["query_id", "query", "cell"])

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(probe, "query_id string, query array<double>, cell int")
    return top_k(match_cells(asked, indexed, cells.parts, k), k).withColumn("score", clamp(F.col("score")))


def match_cells(asked: DataFrame, indexed: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, item_id, score): the best k, ties included, of each cell's parts for the queries (cell, query_id, query) that probe it."""
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    stored = indexed.select("cell", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"), "item_id", "vector")
    names = ["cell", "part", "query_id", "query"]

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "item_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        matrix = _matrix(right.column("vector").combine_chunks()).T
        out = []
        for start in range(0, left.num_rows, QUERIES):
            block = left.slice(start, QUERIES)
            scores = np.round(_matrix(block.column("query").combine_chunks()) @ matrix, DIGITS)
            keep = min(k, scores.shape[1])
            cut_off = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            q, i = np.nonzero(scores >= cut_off[:, None])
            out.append(pa.table({"query_id": block.column("query_id").take(pa.array(q)), "item_id": right.column("item_id").take(pa.array(i)), "score": pa.array(scores[q, i])}))
        return pa.concat_tables(out)

    return asked.select(*names).groupBy("cell", "part").cogroup(stored.groupBy("cell", "part")).applyInArrow(match, "query_id string, item_id string, score double")


# A stored index, searched in rounds


@dataclass
class Stored:
    """Where the index lies, its columns, and of each cell: the angle that holds its rows, their greatest length, their number."""

    path: str
    schema: T.StructType
    cells: Cells
    angle: np.ndarray
    length: np.ndarray
    rows: np.ndarray

    def read(self, spark: SparkSession, cells: list[int], predicate: Column | None = None) -> DataFrame:
        """Rows of these cells that match: whole partitions are left out, and the filter reaches the scan."""
        rows = spark.read.schema(self.schema).parquet(self.path).filter(F.col("cell").isin(cells))
        return rows if predicate is None else rows.filter(predicate)


def store(items: DataFrame, path: str, cells: Cells) -> Stored:
    """Write the index of items (item_id, vector, columns to filter by), partitioned by cell."""
    placed = assign_cells(items.filter("vector IS NOT NULL"), cells)
    names = placed.columns
    at, cell_at = names.index("vector"), names.index("cell")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column(at)), batch.column(cell_at).to_numpy()
                length = np.linalg.norm(x, axis=1)
                cosine = np.einsum("nd,nd->n", x, cells.centroids[own]) / np.maximum(length, 1e-300)
                centre = np.maximum(np.linalg.norm(cells.centroids[own], axis=1), 1e-300)
                yield pa.RecordBatch.from_arrays([batch.column(cell_at), pa.array(np.arccos(np.clip(cosine / centre, -1, 1))), pa.array(length)], ["cell", "angle", "length"])

    placed.repartition("cell").write.partitionBy("cell").option("compression", "zstd").parquet(path)
    spark = items.sparkSession
    written = spark.read.schema(placed.schema).parquet(path)
    facts = written.mapInArrow(measure, "cell int, angle double, length double").groupBy("cell").agg(F.max("angle"), F.max("length"), F.count("*")).collect()  # a row for each cell
    angle, length, rows = (np.zeros(len(cells.centroids)) for _ in range(3))
    for cell, *values in facts:
        angle[cell], length[cell], rows[cell] = values
    return Stored(path, written.schema, cells, angle, length, rows.astype(np.int64))


def cell_order(queries: DataFrame, stored: Stored) -> DataFrame:
    """(query_id, query, cells, bounds, before): the cells that hold rows by falling bound of their scores, and the rows in those before each."""
    used = np.flatnonzero(stored.rows)
    centre = stored.cells.centroids[used]
    centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            size = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
            nearest = np.maximum(np.arccos(np.clip(x @ centre.T / size[:, None], -1, 1)) - stored.angle[used] - 1e-9, 0)
            bound = np.maximum(np.cos(nearest), 0) * stored.length[used] * size[:, None]  # below zero nothing is left out
            bound[nearest >= np.pi / 2] = 0
            by = np.argsort(-bound, axis=1, kind="stable")
            sizes = stored.rows[used][by]
            before = np.cumsum(sizes, axis=1) - sizes
            lists = [pa.array(list(a), pa.list_(t)) for a, t in ((used[by].astype(np.int32), pa.int32()), (np.take_along_axis(bound, by, axis=1), pa.float64()), (before, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["query_id", "query", "cells", "bounds", "before"])

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("query"))
    return asked.mapInArrow(order, "query_id string, query array<double>, cells array<int>, bounds array<double>, before array<bigint>")


def search_rounds(queries: DataFrame, stored: Stored, k: int, filters: dict[str, str] | None = None, max_rows: int = MAX_ROWS, first: int = 2) -> DataFrame:
    """(query_id, item_id, score, rank): the best k rows that match the filters, in strict order; exact unless max_rows rows were scanned before. A cell is probed whole or not at all."""
    if k < 1 or max_rows < 1 or first < 1:
        raise ValueError("k, max_rows and first must be positive")
    spark, predicate = queries.sparkSession, filter_predicate(filters)
    live = cut(cell_order(queries, stored))
    held = spark.createDataFrame([], "query_id string, item_id string, score double")
    at, width = 0, first
    while not live.isEmpty():
        turn = F.explode(F.slice(F.arrays_zip("cells", "before"), at + 1, width))
        probes = live.select("query_id", "query", turn.alias("turn")).filter(F.col("turn.before") < max_rows).select(F.col("turn.cells").alias("cell"), "query_id", "query")
        now = sorted(r.cell for r in probes.select("cell").distinct().collect())  # at most all cells
        found = match_cells(probes, stored.read(spark, now, predicate), stored.cells.parts, k)
        held = cut(top_k(held.unionByName(found), k).drop("rank"))
        at, width = at + width, 2 * width
        worst = held.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        full = (F.col("n") >= k) & (F.col("worst") > F.get("bounds", F.lit(at)) + 10.0**-DIGITS)
        more = (F.size("cells") > at) & (F.get("before", F.lit(at)) < max_rows) & ~F.coalesce(full, F.lit(False))
        live = cut(live.join(worst, "query_id", "left").filter(more).drop("n", "worst"))
    return top_k(held, k).withColumn("score", clamp(F.col("score")))
