"""State machines replayed over an ordered log: token buckets, circuit breaker, cache, and streaming ingest.

A log is dealt by key and sorted by (key, now, seq) within partitions; a task streams through its rows
and holds the state of one key at a time, as the next state depends on the last. Keys spread over tasks,
and a long log of one key costs time but no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replay(log: DataFrame, key: str, columns: list[str], result: str, machine: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Rows (key, seq, *result) of a log (key, now, seq, *columns): machine() makes a key's state, a function of (now, *columns) that returns the result's columns."""
    rows = log.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("now").cast("double").alias("now"), *columns)
    rows = rows.repartition("key").sortWithinPartitions("key", "now", "seq")
    schema = StructType.fromDDL(f"`{key}` string, seq long, {result}")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        current, step = object(), None
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            out = []
            for own, seq, *inputs in zip(*lists):
                if own != current:
                    current, step = own, machine()
                out.append((own, seq, *step(*inputs)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], names)

    return rows.mapInArrow(run, schema)


def bucket_limits(per_minute: Column, bucket_s: float = 10.0) -> tuple[Column, Column]:
    """(capacity, rate) of a limit a minute: what bucket_s seconds allow, 1 at least; and tokens a second."""
    rate = per_minute / 60.0
    return F.greatest(F.lit(1.0), rate * bucket_s), rate


def token_bucket(requests: DataFrame, capacity: float, rate: float, deny_spends_time: bool = False, instances: int = 1) -> DataFrame:
    """(bucket_id, seq, allowed, tokens, retry_after) of requests (bucket_id, seq, now seconds, cost).

    Tokens refill with the time since the last update; a denied request leaves the state as it was
    (deny_spends_time: it keeps the refill) and may retry after the whole seconds its deficit takes. The
    limits are split over instances, with room for one token at least. A bucket that rests for the time it
    takes to fill is as good as new, so that states need not be kept longer.
    """
    if instances > 1:
        capacity, rate = max(1.0, capacity / instances), rate / instances

    def machine():
        tokens, last = capacity, None

        def step(now: float, cost: float) -> tuple[bool, float, int]:
            nonlocal tokens, last
            filled = min(capacity, tokens + max(0.0, now - (now if last is None else last)) * rate)
            if filled >= cost:
                tokens, last = filled - cost, now
                return True, round(tokens, 6), 0
            if deny_spends_time:
                tokens, last = filled, now
            return False, round(filled, 6), math.ceil((cost - filled) / rate)

        return step

    return replay(requests, "bucket_id", ["cost"], "allowed boolean, tokens double, retry_after long", machine)


def two_tiers(requests: DataFrame, first: str, second: str, limit: tuple[float, float], second_limit: tuple[float, float] | None = None) -> DataFrame:
    """(seq, allowed, denied_by): the first bucket decides, and only what it allows spends from the second. Limits are (capacity, rate); the second's falls back to the first's."""
    one = token_bucket(requests.withColumn("bucket_id", F.col(first)), *limit).select("seq", F.col("allowed").alias("by_first"))
    passed = requests.join(one.filter("by_first"), "seq").withColumn("bucket_id", F.col(second))
    two = token_bucket(passed, *(second_limit or limit)).select("seq", F.col("allowed").alias("by_second"))
    joined = one.join(two, "seq", "left")
    return joined.select("seq", F.coalesce(F.col("by_first") & F.col("by_second"), F.lit(False)).alias("allowed"), F.when(~F.col("by_first"), first).when(~F.col("by_second"), second).alias("denied_by"))


def circuit_breaker(calls: DataFrame, threshold: int, backoff_s: float, most_s: float) -> DataFrame:
    """(name, seq, state, admitted) of calls (name, seq, now, failed): the state at each call and whether it ran.

    threshold failures in a row open the breaker; after the backoff one probe runs half open: success
    closes it, failure opens it again with twice the backoff, most_s at most. failed is null for an
    error that tells nothing of the dependency: it changes nothing, and after such a probe the breaker
    stays half open and refuses.
    """

    def machine():
        state, failures, wait, opened = "closed", 0, backoff_s, 0.0

        def step(now: float, failed: bool | None) -> tuple[str, bool]:
            nonlocal state, failures, wait, opened
            probing = state == "half_open"
            if state == "open" and now - opened >= wait:
                state = "half_open"
            seen = state
            if state == "open" or probing:
                return seen, False
            if failed is None:
                return seen, True
            if not failed:
                state, failures, wait = "closed", 0, backoff_s
                return seen, True
            failures += 1
            if seen == "half_open":
                state, opened, wait = "open", now, min(most_s, wait * 2)
            elif failures >= threshold:
                state, opened = "open", now
            return seen, True

        return step

    return replay(calls, "name", ["failed"], "state string, admitted boolean", machine)


def cache_replay(requests: DataFrame, ttl_s: float, negative_ttl_s: float = 30.0) -> DataFrame:
    """(key, seq, outcome) of requests (key, seq, now, backend, found).

    backend is ok, open (the breaker refuses: bypass) or down (error); found tells what the request's own
    computation gives: value, nothing, or corrupt for a value that is stored broken. A lookup that a living
    entry answers is a hit, negative if it stands for nothing, an error if it is corrupt; else a miss. Any
    outcome but hit and negative stores anew if the backend is ok, for ttl_s, or negative_ttl_s for nothing.
    """

    def machine():
        entry, until = None, 0.0

        def step(now: float, backend: str, found: str) -> tuple[str]:
            nonlocal entry, until
            if backend != "ok":
                return ("bypass" if backend == "open" else "error",)
            alive = entry if entry is not None and now < until else None
            if alive in ("value", "nothing"):
                return ("hit" if alive == "value" else "negative",)
            entry, until = found, now + (negative_ttl_s if found == "nothing" else ttl_s)
            return ("miss" if alive is None else "error",)

        return step

    return replay(requests, "key", ["backend", "found"], "outcome string", machine)


def ingest_stream(events: DataFrame, now: Column, delay: str = "7 days") -> DataFrame:
    """A stream of events without repeats of an id within the watermark and without events outside the window."""
    from tessaline.operators.events import in_window

    return events.filter(in_window(F.col("event_ts"), now)).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(log: DataFrame, ts: str, width: str, *labels: str) -> DataFrame:
    """Rows per window and labels; works on streams with a watermark and on tables."""
    return log.groupBy(F.window(ts, width).alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def sessions(log: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Sessions of each key: a gap of more than gap_s seconds begins a new one."""
    order = Window.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order)) > gap_s * 1_000_000).cast("int")
    numbered = log.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(order))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
