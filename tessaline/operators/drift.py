"""Drift of vectors between two windows: principal components of the reference window, and the stability of each.

Moments are mergeable: each task sends a count, a sum and a matrix of products, D rows of D numbers, which Spark
adds; only the D x D covariance reaches the driver, whatever the number of vectors. Components are its
eigenvectors. Rows are projected in place, and each component's scores are binned by the quantiles of the
reference window, exact ones by distributed selection, which both windows share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators.percentiles import exact_percentiles

LEAST = 1e-4  # share that an empty bin counts as


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    covariance: np.ndarray


def moments(rows: DataFrame, vector: str) -> Moments:
    """Count, mean and sample covariance of a column of vectors of one length; null vectors do not count."""
    kept = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    first = kept.first()
    if first is None:
        return Moments(0, np.empty(0), np.empty((0, 0)))
    pivot = np.array(first.v)  # sums of differences from a row keep their digits
    dim = len(pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - pivot
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim), "total": pa.array(total), "products": pa.array(list(products), pa.list_(pa.float64()))})

    sent = kept.mapInArrow(run, "at int, n bigint, total double, products array<double>")
    sums = sent.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), *[F.sum(F.col("products")[j]).alias(f"p{j}") for j in range(dim)])
    found = sorted(sums.collect())  # a row for each dimension
    n, total = found[0].n, np.array([r.total for r in found])
    products = np.array([list(r)[3:] for r in found])
    covariance = (products - np.outer(total, total) / n) / max(n - 1, 1)
    return Moments(n, pivot + total / n, covariance)


def components(of: Moments, k: int) -> np.ndarray:
    """(k, D): the unit eigenvectors of the k greatest eigenvalues; the component of greatest size is positive, which fixes the sign."""
    _, vectors = np.linalg.eigh(of.covariance)
    top = vectors[:, ::-1][:, :k].T
    lead = top[np.arange(len(top)), np.abs(top).argmax(axis=1)]
    return top * np.sign(lead)[:, None]


def project(rows: DataFrame, period: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(period, component, score): a row for each vector and axis; null vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = (_matrix(batch.column(1)) - mean) @ axes.T
                row = np.repeat(np.arange(len(scores)), len(axes))
                yield pa.RecordBatch.from_pydict({"period": batch.column(0).take(pa.array(row)), "component": pa.array(np.tile(np.arange(1, len(axes) + 1, dtype=np.int32), len(scores))), "score": pa.array(scores.ravel())})

    own = rows.filter(F.col(vector).isNotNull()).select(F.col(period).cast("int").alias("period"), F.col(vector).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "period int, component int, score double")


def stability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(component, psi) of (period 0 or 1, component, score): bins between the quantiles of period 0, a score on an edge in the upper bin; shares below LEAST count as LEAST. A component needs rows in period 0."""
    fractions = [i / bins for i in range(1, bins)]
    edges = exact_percentiles(scores.filter("period = 0"), "score", fractions, "component")
    edges = edges.groupBy("component").agg(F.sort_array(F.collect_list("value")).alias("edges"))  # bins - 1 for each component
    binned = scores.join(F.broadcast(edges), "component").withColumn("bin", F.size(F.filter("edges", lambda e: F.col("score") >= e)))
    counts = binned.groupBy("component", "bin").agg(F.count_if(F.col("period") == 0).alias("a"), F.count_if(F.col("period") == 1).alias("b"))
    every = edges.select("component", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["component", "bin"], "left").na.fill(0, ["a", "b"])
    totals = counts.groupBy("component").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0)), F.lit(LEAST))
    p, q = share("a", "ta"), share("b", "tb")
    return every.join(F.broadcast(totals), "component").groupBy("component").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def component_drift(rows: DataFrame, period: str, vector: str, k: int = 5, bins: int = 10) -> DataFrame:
    """(component, psi): stability of the scores on the k first components of period 0."""
    reference = moments(rows.filter(F.col(period) == 0), vector)
    if not reference.n:
        return rows.sparkSession.createDataFrame([], "component int, psi double")
    return stability(project(rows, period, vector, reference.mean, components(reference, k)), bins)
