"""Rate limits on streams: token buckets as keyed state with timers, which expire when a bucket is full again.

Each bucket keeps (tokens, last, until) as value state. A timer at ``until``, twice the time that filling the bucket
takes after the last request that was allowed, clears the state once the watermark has passed it: a new bucket
equals one that had so much time to fill. Rows of a bucket within a batch are taken in the order of (ts, seq). State lives
in the RocksDB store with the stream's checkpoint, from which a stream goes on after a stop. Decisions equal those of
``streaming.state.token_bucket`` over the whole log, wherever the batches end, while no row is later than the watermark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "bucket_id string, seq long, ts timestamp, cost double, other string, passed boolean, allowed boolean, tokens double, retry_after long"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def ttl_seconds(capacity: float, rate: float) -> int:
    return max(2, 2 * math.ceil(capacity / rate))


class TokenBucket(StatefulProcessor):
    """A bucket of capacity that refills at rate a second. A row that has not passed an earlier tier spends nothing."""

    def __init__(self, capacity: float, rate: float, deny_spends_time: bool):
        self.capacity, self.rate, self.deny_spends_time = capacity, rate, deny_spends_time
        self.ttl = ttl_seconds(capacity, rate)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, last double, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")  # of one bucket in one batch
        tokens, last, until = self.state.get() if self.state.exists() else (self.capacity, None, None)
        before, known = until, until is not None
        out = []
        for now, cost, passed in zip(data["now"], data["cost"], data["passed"], strict=True):
            if not passed:
                out.append((False, None, None))
                continue
            filled = min(self.capacity, tokens + max(0.0, now - (now if last is None else last)) * self.rate)
            if filled >= cost:
                tokens, last, until = filled - cost, now, int((now + self.ttl) * 1000)
                out.append((True, round(tokens, 6), 0))
                continue
            if self.deny_spends_time:
                tokens, last, until = filled, now, int((now + self.ttl) * 1000)
            out.append((False, round(filled, 6), math.ceil((cost - filled) / self.rate)))
        if until is not None:
            if known and before != until:
                self.handle.deleteTimer(before)
            if before != until:
                self.handle.registerTimer(until)
            self.state.update((tokens, last, until))
        found = pd.DataFrame(out, columns=["allowed", "tokens", "retry_after"])
        kept = data[["seq", "ts", "cost", "other", "passed"]].reset_index(drop=True)
        kept.insert(0, "bucket_id", key[0])
        yield pd.concat([kept, found.astype({"allowed": bool, "tokens": "float64", "retry_after": "Int64"})], axis=1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists() and self.state.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _decide(rows: DataFrame, capacity: float, rate: float, deny_spends_time: bool) -> DataFrame:
    own = rows.select("bucket_id", "seq", "ts", (F.unix_micros("ts") / 1e6).alias("now"), "cost", "other", "passed")
    return own.groupBy("bucket_id").transformWithStateInPandas(TokenBucket(capacity, rate, deny_spends_time), DECISIONS, "Append", "EventTime", eventTimeColumnName="ts")


def token_bucket_stream(requests: DataFrame, capacity: float, rate: float, deny_spends_time: bool = False, instances: int = 1, delay: str = "1 minute") -> DataFrame:
    """A stream (bucket_id, seq, allowed, tokens, retry_after) of a stream of requests (bucket_id, seq, ts timestamp, cost); parameters as in the batch form."""
    if instances > 1:
        capacity, rate = max(1.0, capacity / instances), rate / instances
    use_keyed_state(requests.sparkSession)
    rows = requests.withWatermark("ts", delay).select("bucket_id", "seq", "ts", "cost", F.lit(None).cast("string").alias("other"), F.lit(True).alias("passed"))
    return _decide(rows, capacity, rate, deny_spends_time).select("bucket_id", "seq", "allowed", "tokens", "retry_after")


def two_tier_stream(requests: DataFrame, first: str, second: str, limit: tuple[float, float], second_limit: tuple[float, float] | None = None, delay: str = "1 minute") -> DataFrame:
    """A stream (seq, allowed, denied_by): what the bucket of the first column allows spends from the second's; what it denies passes through the second tier without spending."""
    use_keyed_state(requests.sparkSession)
    rows = requests.withWatermark("ts", delay).select(F.col(first).alias("bucket_id"), "seq", "ts", "cost", F.col(second).alias("other"), F.lit(True).alias("passed"))
    one = _decide(rows, *limit, False).select(F.col("other").alias("bucket_id"), "seq", "ts", "cost", F.col("bucket_id").alias("other"), F.col("allowed").alias("passed"))
    two = _decide(one, *(second_limit or limit), False)
    return two.select("seq", "allowed", F.when(~F.col("passed"), first).when(~F.col("allowed"), second).alias("denied_by"))


def write_batches(rows: DataFrame, ts: str, path: str, batches: int) -> None:
    """rows in path as files that a stream reads in the order of time, one write after another."""
    cuts = rows.select(F.percentile_approx(ts, [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows
        if low is not None:
            part = part.filter(F.col(ts) >= F.lit(low))
        if high is not None:
            part = part.filter(F.col(ts) < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """Run a stream over what its source has, append to Parquet in path, and stop; returns the query."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
