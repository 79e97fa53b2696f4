"""Churn risk: features of users' activity, labels, splits by time, and a choice between two models.

A user who was active before a cutoff churns if no event falls within the horizon after it. Features see
only what precedes the cutoff. Train, validation and test examples have cutoffs of their own, and the
horizon of each ends before the next cutoff, so no label of one split is a feature of an earlier one. The model with
the greater area under the curve on the validation split is chosen; figures come from the test split.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators import statistics
from tessaline.session import cut

FEATURES = ("recency_days", "events", "active_days", "kinds", "value", "trend")
SPLITS = ("train", "validation", "test")


def examples(events: DataFrame, cutoff: datetime, lookback_days: int, horizon_hours: int) -> DataFrame:
    """(user_id, FEATURES, label) of the users with an event in the lookback before the cutoff, from (user_id, ts, kind, value). trend is the share of events in the lookback's second half, from -1 to 1."""
    at, since, until = (F.lit(str(t)).cast("timestamp_ntz") for t in (cutoff, cutoff - timedelta(days=lookback_days), cutoff + timedelta(hours=horizon_hours)))
    half = F.lit(str(cutoff - timedelta(days=lookback_days / 2))).cast("timestamp_ntz")
    before = F.col("ts") < at
    rows = events.filter((F.col("ts") >= since) & (F.col("ts") < until))  # reaches the scan
    known = lambda c: F.when(before, c)
    n, late = F.count(known(F.lit(1))), F.count(F.when(before & (F.col("ts") >= half), 1))
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    recency = (micros(at) - F.max(known(micros(F.col("ts"))))) / 86_400e6
    found = rows.groupBy("user_id").agg(
        recency.alias("recency_days"), n.cast("double").alias("events"), F.countDistinct(known(F.to_date("ts"))).cast("double").alias("active_days"), F.countDistinct(known(F.col("kind"))).cast("double").alias("kinds"),
        F.coalesce(F.avg(known(F.col("value"))), F.lit(0.0)).alias("value"), ((2 * late - n) / F.greatest(n, F.lit(1))).alias("trend"), (F.count_if(~before) == 0).cast("int").alias("label"),
    )
    return found.filter("events > 0")


def split_by_time(events: DataFrame, cutoffs: dict[str, list[datetime]], lookback_days: int, horizon_hours: int) -> DataFrame:
    """(split, cutoff, user_id, FEATURES, label). cutoffs: of each of SPLITS, in time."""
    order = [(c, s) for s in SPLITS for c in sorted(cutoffs[s])]
    for (a, s), (b, t) in zip(order, order[1:], strict=False):
        if b <= a or s != t and a + timedelta(hours=horizon_hours) > b:
            raise ValueError(f"the horizon of {s} at {a} reaches beyond the cutoff of {t} at {b}")
    parts = [examples(events, c, lookback_days, horizon_hours).select(F.lit(s).alias("split"), F.lit(str(c)).cast("timestamp_ntz").alias("cutoff"), "*") for c, s in order]
    return reduce(DataFrame.unionByName, parts)


def models(seed: int = 7) -> dict[str, Pipeline]:
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="raw")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    logistic = LogisticRegression(maxIter=50, regParam=0.01)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed)
    return {"logistic": Pipeline(stages=[assembled, scaled, logistic]), "boosted_trees": Pipeline(stages=[assembled, scaled, trees])}


def fit_and_score(data: DataFrame, seed: int = 7) -> DataFrame:
    """(model, split, cutoff, user_id, label, score) of validation and test, by models that saw the train split only. A train split of one class has no model and gives no row."""
    data = cut(data)
    train = data.filter("split = 'train'")
    schema = "model string, split string, cutoff timestamp_ntz, user_id " + dict(data.dtypes)["user_id"] + ", label int, score double"
    if train.select("label").distinct().count() < 2:
        return data.sparkSession.createDataFrame([], schema)
    out = []
    for name, pipeline in models(seed).items():
        scored = pipeline.fit(train).transform(data.filter("split <> 'train'"))
        out.append(scored.select(F.lit(name).alias("model"), "split", "cutoff", "user_id", "label", vector_to_array("probability")[1].alias("score")))
    return cut(reduce(DataFrame.unionByName, out))


def evaluate(scores: DataFrame) -> DataFrame:
    """(model, split, n, positives, auc, brier, chosen): chosen is the model with the greatest AUC on validation, the first by name of equal ones. AUC is null for a split of one class."""
    auc = statistics.area_under_curve(scores, "model", "split")
    facts = scores.groupBy("model", "split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"))
    rows = cut(facts.join(auc, ["model", "split"], "left"))  # a row for each model and split
    best = rows.filter("split = 'validation'").orderBy(F.desc_nulls_last("auc"), "model").limit(1).select(F.col("model").alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("model", "split", "n", "positives", "auc", "brier", (F.col("model") == F.col("best")).alias("chosen"))


def reliability(scores: DataFrame, evaluation: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) of the chosen model on the test split."""
    chosen = evaluation.filter("chosen").select("model").distinct()
    return statistics.calibration(scores.filter("split = 'test'").join(F.broadcast(chosen), "model", "left_semi"), bins)
