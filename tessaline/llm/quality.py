"""Quality classifier from positives and unlabelled text (non-negative PU learning).

Trusted positives are rows labelled 1, unlabelled rows are any documents; rows labelled 0
serve only to estimate the class prior (the share of 1 among the labelled rows). The model
is a network of one hidden layer over surface statistics of the whole text. It minimises the
non-negative unbiased risk: prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior *
R(positives as 0)); where the second part is negative, its gradient is reversed. Fitting
takes at most ``max_positives`` and ``max_unlabelled`` rows, those with the least hash of
doc_id, so that a bounded sample reaches the driver; scoring takes every row.

Defined results: null and empty texts get the score of an empty text; very long texts are scored
whole; rows with a null doc_id are scored, never learnt from, and not held out; without usable positives the score is
the prior for every row (0.5 without labels); a document counts as positive if any of its label rows
is 1; a doc_id with several texts is learnt from once, by the least of its texts, and every row is
scored; other columns of both tables are ignored, whatever their names (score and predicted of the
documents are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POSITIVES, MAX_UNLABELLED = 8_000, 16_000
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 30, 512, 3e-3, 1e-4, 7
TINY = 1e-9

_KIND = np.zeros(256, dtype=np.int64)  # other
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[ord(" ")] = 4
_KIND[ord("\n")] = 5
_KIND[[ord("."), ord(",")]] = 6
_KIND[[ord(c) for c in "!?;:'\"-()"]] = 7
_KIND[0x80:] = 8
KINDS = 9


def features(text: str | None) -> np.ndarray:
    """Surface statistics of a text; all finite, also for an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(len(data), 1)
    marks = np.bincount(data, minlength=256)[33:127]
    kinds = _KIND[data]
    pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(data) > 1 else np.zeros(KINDS * KINDS)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    shape = [
        np.log1p(len(data)), np.log1p(len(words)), len(counts) / w, top / w, len(set(zip(words, words[1:]))) / w,
        lengths.mean(), lengths.std(), np.mean(lengths <= 3), np.mean(lengths > 20), len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(words) / len(lines)),
        sum(x.isupper() for x in words) / w, sum(not x[-1].isalnum() for x in words) / w, sum(not x.isalnum() for x in words) / w,
    ]
    return np.concatenate([np.sqrt(marks / n), np.sqrt(pairs / n), shape]).astype(np.float32)


@dataclass
class Model:
    """Weights of the network; score() is the probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z, np.tanh(z @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x)[1] @ self.w2 + self.b2, -30, 30)))


def risk(model: Model, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk in log loss: positives as 1, and unlabelled rows as 0 without the positives' share of that."""
    su, sp = model.score(unlabelled), model.score(positive)
    return prior * float(np.mean(-np.log(sp + TINY))), float(np.mean(-np.log(1 - su + TINY)) - prior * np.mean(-np.log(1 - sp + TINY)))


def gradient(model: Model, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """Gradient of the sum of both parts; where the second is negative, of its negative alone."""
    (zu, hu), (zp, hp) = model.hidden(unlabelled), model.hidden(positive)
    su, sp = (1 / (1 + np.exp(-np.clip(h @ model.w2 + model.b2, -30, 30))) for h in (hu, hp))
    as_zero = np.mean(-np.log(1 - su + TINY)) - prior * np.mean(-np.log(1 - sp + TINY))
    if as_zero >= 0:
        gu, gp = su / len(unlabelled), prior * ((sp - 1) - sp) / len(positive)
    else:
        gu, gp = -su / len(unlabelled), prior * sp / len(positive)
    bu, bp = np.outer(gu, model.w2) * (1 - hu**2), np.outer(gp, model.w2) * (1 - hp**2)
    return {"w2": hu.T @ gu + hp.T @ gp, "b2": gu.sum() + gp.sum(), "w1": zu.T @ bu + zp.T @ bp, "b1": bu.sum(axis=0) + bp.sum(axis=0)}


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative risk by Adam, in batches."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    d = every.shape[1]
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    names = ("w1", "b1", "w2", "b2")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    step = 0
    rounds = max(1, -(-len(unlabelled) // BATCH))
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for r in range(rounds):
            u, p = unlabelled[order_u[r::rounds]], positive[order_p[r::rounds]] if len(positive) >= rounds else positive
            grads = gradient(model, u, p, prior)
            grads["w1"] = grads["w1"] + DECAY * model.w1
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                setattr(model, k, getattr(model, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["role", "doc_id", "x"])


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> tuple[Model | None, float]:
    """The model and the estimated prior, from rows outside the held-out fold."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = marked.agg(F.avg(F.col("quality").cast("double")).alias("p")).first().p
    prior = min(0.99, max(0.01, share if share is not None else 0.5))
    by_hash = F.xxhash64("doc_id")
    positives = marked.filter("quality = 1").orderBy(by_hash, "doc_id").limit(max_positives).select("doc_id", F.lit(1).alias("role"))
    others = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).distinct().orderBy(by_hash, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("role"))
    chosen = positives.unionByName(others)  # max_positives + max_unlabelled rows at most
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "role").agg(F.min("text").alias("text"))  # however often a document occurs
    rows = rows.select("role", "text", F.col("doc_id").cast("string")).repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    sample = rows.mapInArrow(_features, "role int, doc_id string, x binary").toArrow().sort_by([("role", "ascending"), ("doc_id", "ascending")])  # the same order however rows were dealt
    role = sample.column("role").to_numpy()
    if not (role == 1).any() or not (role == 0).any():
        return None, prior
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), dtype=np.float32).reshape(len(role), -1)
    return fit(x[role == 1], x[role == 0], prior), prior


def score(docs: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """docs with score and predicted, which replace columns of these names. Only texts and scores pass through Python."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n = len(texts)
            if model is None or not n:
                yield pa.array(np.full(n, prior), pa.float64())
            else:
                yield pa.array(model.score(np.array([features(texts[i].as_py()) for i in range(n)])), pa.float64())

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    run = F.arrow_udf(scores, "double").asNondeterministic()  # evaluated once, wherever it is used
    scored = docs.drop("score", "predicted").withColumn("score", run(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted, learnt from labels."""
    return score(docs, *train(docs, labels))
