"""Event batches: validation, hashing, idempotent insert, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.hashing import event_id, hmac_sha256
from tessaline.operators.percentiles import exact_percentiles

#: Fixed values of the event model.
EVENT_TYPES = ("impression", "click", "conversion")
MAX_AGE_S, MAX_FUTURE_S = 604_800, 300
ID_LENGTH, BATCH_SIZE = (8, 64), (1, 100)


def in_window(ts: Column, now: Column, max_age_s: int = MAX_AGE_S, max_future_s: int = MAX_FUTURE_S) -> Column:
    """Whether an event's time is acceptable; both bounds are inclusive."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6)
    return (age <= max_age_s) & (age >= -max_future_s)


def valid_envelope() -> Column:
    """An id of 8 to 64 characters or none, a known type, and a position from 1 or none."""
    id_ok = F.col("event_id").isNull() | F.length("event_id").between(*ID_LENGTH)
    return id_ok & F.col("event_type").isin(*EVENT_TYPES) & (F.col("position").isNull() | (F.col("position") >= 1))


def valid_batches(batch: DataFrame) -> DataFrame:
    """(request_id, n, valid): whether a batch has from 1 to 100 events, all of them with valid envelopes."""
    own = batch.groupBy("request_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(valid_envelope(), F.lit(False))).alias("sound"))
    return own.select("request_id", "n", (F.col("n").between(*BATCH_SIZE) & F.col("sound")).alias("valid"))


def retained(rows: DataFrame, ts: str, now: Column, days: int = 365) -> DataFrame:
    """Rows of the last days before now; the comparison reaches the scan. now has the type of ts."""
    return rows.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def outcome_counts(rows: DataFrame, *labels: str) -> DataFrame:
    """A counter: rows by labels."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """(labels, le, n): rows at or below each bound, in one pass without an expansion of rows."""
    g = rows.groupBy(*labels).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(str(i)) for i, b in enumerate(bounds)])
    long = g.unpivot(list(labels), [str(i) for i in range(len(bounds))], "at", "n")
    return long.select(*labels, F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("at").cast("int") + 1).alias("le"), "n")


def latency_percentiles(rows: DataFrame, value: str, *labels: str) -> DataFrame:
    """(labels, p50, p95, p99, n): exact percentiles with linear interpolation, and all rows of each group."""
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("value")))
    found = exact_percentiles(rows, value, list(names.values()), *labels).groupBy(*labels).agg(*[at(f).alias(c) for c, f in names.items()])
    found = found.select(*[F.col(c).alias(f"_{c}") for c in labels], *names)
    counts = rows.groupBy(*labels).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in labels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(found, same, "left").select(*labels, *names, "n")


def valid_row() -> Column:
    """Row checks of the stored table."""
    return F.col("user_id_hash").rlike("^[0-9a-f]{64}$") & F.col("event_type").isin(*EVENT_TYPES) & (F.col("position").isNull() | (F.col("position") >= 1)) & (F.col("experiment_name").isNull() == F.col("experiment_variant").isNull())


def first_violation(batch: DataFrame, now: Column) -> DataFrame:
    """(request_id, first_bad): index of a batch's first event outside the window; null if all are inside."""
    bad = F.min(F.when(~in_window(F.col("event_ts"), now), F.col("index")))
    return batch.groupBy("request_id").agg(bad.alias("first_bad"))


def prepare(batch: DataFrame, key: bytes, key_version: int, now: Column) -> DataFrame:
    """Rows to store: batches with an event outside the window are left out whole; users are hashed; missing ids are made from request and index."""
    bad = first_violation(batch, now).filter("first_bad IS NOT NULL").select("request_id")
    kept = batch.join(bad, "request_id", "left_anti")
    return kept.withColumn("event_id", F.coalesce("event_id", event_id(F.col("request_id"), F.col("index")))).withColumn("user_id_hash", hmac_sha256(key, F.col("user_id"))).withColumn("user_id_hash_version", F.lit(key_version)).drop("user_id")


def insert_ignore(existing: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of batch to append: the first of each key by order, unless existing holds the key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batch.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").join(existing.select(key), key, "left_anti")


def accounting(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: accepted, duplicates, rejected (0: a bad event aborts its batch before)."""
    total = batch.agg(F.count("*").alias("n"))
    return inserted.agg(F.count("*").alias("accepted")).crossJoin(F.broadcast(total)).select("accepted", (F.col("n") - F.col("accepted")).alias("duplicates"), F.lit(0).cast("long").alias("rejected"))
