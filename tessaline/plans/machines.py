"""State machines over the request log, the event and exposure stores, counters, and statistics of experiments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessaline.operators import churn, drift, events, experiments, statistics
from tessaline.plans import activity as act
from tessaline.plans import fixtures as fx
from tessaline.plans import registry
from tessaline.plans.registry import query
from tessaline.plans.rules import KEY, hmac_sql
from tessaline.session import shared_folder, table
from tessaline.streaming import limits, state

LOG = """log AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY now, seq) AS n FROM (
    SELECT event_id AS seq, {key} AS key, epoch_us(ts) / 1e6 AS now, event_type, user_id FROM {source}))"""


def _requests(spark, sf_dir):
    """events as a request log."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("bucket_id"), F.concat(F.lit("ip"), (F.col("user_id") % 20).cast("string")).alias("ip"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), F.lit(1.0).alias("cost"), "event_type", "user_id")


def bucket_sql(name: str, log: str, capacity: float, rate: float, deny_spends_time: bool = False) -> str:
    """A recursive table of a token bucket, one request of each key at a step."""
    filled = f"least({capacity!r}::DOUBLE, r.left_ + greatest(0, l.now - r.last) * {rate!r}::DOUBLE)"
    stays = (filled, "l.now") if deny_spends_time else ("r.left_", "r.last")
    return f"""{name} AS (
  SELECT key, seq, n, {capacity!r}::DOUBLE >= 1 AS allowed, {capacity!r}::DOUBLE AS filled, CASE WHEN {capacity!r} >= 1 THEN {capacity!r} - 1 ELSE {capacity!r} END::DOUBLE AS left_, now AS last FROM {log} WHERE n = 1
  UNION ALL
  SELECT l.key, l.seq, l.n, {filled} >= 1, {filled}, CASE WHEN {filled} >= 1 THEN {filled} - 1 ELSE {stays[0]} END, CASE WHEN {filled} >= 1 THEN l.now ELSE {stays[1]} END
  FROM {name} r JOIN {log} l ON l.key = r.key AND l.n = r.n + 1)"""


BUCKET_ROWS = "SELECT key AS bucket_id, seq, allowed, round(CASE WHEN allowed THEN filled - 1 ELSE filled END, 6) AS tokens, CASE WHEN allowed THEN 0 ELSE CAST(ceil((1 - filled) / {rate!r}::DOUBLE) AS BIGINT) END AS retry_after FROM run"


DAY = 1 / 86_400


@query("st1_token_bucket", "WITH RECURSIVE " + LOG.format(key="'u' || user_id", source="events") + ", " + bucket_sql("run", "log", 3.0, DAY) + BUCKET_ROWS.format(rate=DAY))
def st1_token_bucket(spark, sf_dir):
    return state.token_bucket(_requests(spark, sf_dir), capacity=3.0, rate=DAY)


@query("st2_token_bucket_memory", "WITH RECURSIVE " + LOG.format(key="'u' || user_id", source="events") + ", " + bucket_sql("run", "log", 1.5, DAY / 2, True) + BUCKET_ROWS.format(rate=DAY / 2))
def st2_token_bucket_memory(spark, sf_dir):
    """The in-memory variant: limits split over two instances, a denial spends the time."""
    return state.token_bucket(_requests(spark, sf_dir), capacity=3.0, rate=DAY, deny_spends_time=True, instances=2)


HALF_DAY = 1 / 43_200
FIRST, SECOND = (5.0, HALF_DAY), (2.0, DAY / 2)


@query("st3_two_tiers", "WITH RECURSIVE " + LOG.format(key="'ip' || (user_id % 20)", source="events") + ", " + bucket_sql("one", "log", *FIRST) + ", passed AS (" + "SELECT l.key AS old, l.seq, l.now, l.user_id, 'u' || l.user_id AS key, row_number() OVER (PARTITION BY l.user_id ORDER BY l.now, l.seq) AS n FROM log l JOIN one o USING (seq) WHERE o.allowed), " + bucket_sql("two", "passed", *SECOND) + """
SELECT o.seq, coalesce(o.allowed AND t.allowed, false) AS allowed, CASE WHEN NOT o.allowed THEN 'ip' WHEN NOT t.allowed THEN 'user' END AS denied_by FROM one o LEFT JOIN two t USING (seq)""")
def st3_two_tiers(spark, sf_dir):
    """Addresses and users with limits of their own."""
    return state.two_tiers(_requests(spark, sf_dir).withColumn("user", F.col("bucket_id")).drop("bucket_id"), "ip", "user", FIRST, SECOND)


def _streamed(spark, sf_dir, decide):
    """What a stream of the requests in several batches decides, from a file sink."""
    folder = shared_folder(spark, "limits")
    rows = _requests(spark, sf_dir).select("bucket_id", F.col("bucket_id").alias("user"), "ip", "seq", F.timestamp_micros(F.round(F.col("now") * 1e6).cast("long")).alias("ts"), "cost")
    limits.write_batches(rows, "ts", f"{folder}/in", 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = decide(stream)
    limits.run_available(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("st1_token_bucket_stream", "WITH RECURSIVE " + LOG.format(key="'u' || user_id", source="events") + ", " + bucket_sql("run", "log", 3.0, DAY) + BUCKET_ROWS.format(rate=DAY))
def st1_token_bucket_stream(spark, sf_dir):
    """The same decisions by a stream with keyed state that expires."""
    return _streamed(spark, sf_dir, lambda rows: limits.token_bucket_stream(rows, 3.0, DAY))


@query("st3_two_tiers_stream", registry.ORACLE["st3_two_tiers"])
def st3_two_tiers_stream(spark, sf_dir):
    """Both tiers as one stream of two stateful steps."""
    return _streamed(spark, sf_dir, lambda rows: limits.two_tier_stream(rows, "ip", "user", FIRST, SECOND))


FAILED = "CASE WHEN event_type = 'signup' AND seq % 50 = 0 THEN NULL ELSE event_type = 'error' END"


@query("st4_circuit_breaker", "WITH RECURSIVE " + LOG.format(key="'ip' || (user_id % 20)", source="events") + f""", calls AS (SELECT *, {FAILED} AS failed FROM log),
run AS (
  SELECT key, seq, n, 'closed' AS state, true AS admitted, CASE WHEN 1 >= 2 AND failed THEN 'open' ELSE 'closed' END AS after, CASE WHEN failed THEN 1 ELSE 0 END AS failures, 3600.0::DOUBLE AS wait, 0.0::DOUBLE AS opened FROM calls WHERE n = 1
  UNION ALL
  SELECT key, seq, n, state, admitted,
    CASE WHEN NOT admitted OR failed IS NULL THEN state WHEN NOT failed THEN 'closed' WHEN state = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE state END,
    CASE WHEN NOT admitted OR failed IS NULL THEN failures WHEN NOT failed THEN 0 ELSE failures + 1 END,
    CASE WHEN NOT admitted OR failed IS NULL THEN wait WHEN NOT failed THEN 3600.0 WHEN state = 'half_open' THEN least(14400.0, wait * 2) ELSE wait END,
    CASE WHEN admitted AND failed AND (state = 'half_open' OR failures + 1 >= 2) THEN now ELSE opened END
  FROM (SELECT c.key, c.seq, c.n, c.now, c.failed, r.failures, r.wait, r.opened, CASE WHEN r.after = 'open' AND c.now - r.opened >= r.wait THEN 'half_open' ELSE r.after END AS state, r.after = 'closed' OR r.after = 'open' AND c.now - r.opened >= r.wait AS admitted
    FROM run r JOIN calls c ON c.key = r.key AND c.n = r.n + 1))
SELECT key AS name, seq, state, admitted FROM run""")
def st4_circuit_breaker(spark, sf_dir):
    """Calls that fail, and some that end in an error that tells nothing."""
    rows = _requests(spark, sf_dir)
    failed = F.when(~((F.col("event_type") == "signup") & (F.col("seq") % 50 == 0)), F.col("event_type") == "error")
    return state.circuit_breaker(rows.select(F.col("ip").alias("name"), "seq", "now", failed.alias("failed")), threshold=2, backoff_s=3600.0, most_s=14_400.0)


@query("st5_cache_replay", "WITH RECURSIVE " + LOG.format(key="'u' || (user_id % 40)", source="events") + """,
asked AS (SELECT *, CASE WHEN seq % 23 = 0 THEN 'open' WHEN seq % 29 = 0 THEN 'down' ELSE 'ok' END AS backend, CASE WHEN seq % 5 = 0 THEN 'nothing' WHEN seq % 7 = 0 THEN 'corrupt' ELSE 'value' END AS found FROM log),
run AS (
  SELECT key, seq, n, CASE backend WHEN 'open' THEN 'bypass' WHEN 'down' THEN 'error' ELSE 'miss' END AS outcome, CASE WHEN backend = 'ok' THEN found END AS entry, CASE WHEN backend = 'ok' THEN now + CASE WHEN found = 'nothing' THEN 3600 ELSE 14400 END ELSE 0 END::DOUBLE AS until_ FROM asked WHERE n = 1
  UNION ALL
  SELECT key, seq, n, CASE WHEN backend = 'open' THEN 'bypass' WHEN backend = 'down' THEN 'error' WHEN alive = 'value' THEN 'hit' WHEN alive = 'nothing' THEN 'negative' WHEN alive = 'corrupt' THEN 'error' ELSE 'miss' END,
    CASE WHEN backend <> 'ok' OR alive IN ('value', 'nothing') THEN entry ELSE found END, CASE WHEN backend <> 'ok' OR alive IN ('value', 'nothing') THEN until_ ELSE now + CASE WHEN found = 'nothing' THEN 3600 ELSE 14400 END END
  FROM (SELECT a.*, r.entry, r.until_, CASE WHEN a.now < r.until_ THEN r.entry END AS alive FROM run r JOIN asked a ON a.key = r.key AND a.n = r.n + 1))
SELECT key, seq, outcome FROM run""")
def st5_cache_replay(spark, sf_dir):
    """A cache whose backend is away at times, with empty and with broken values."""
    s = F.col("seq")
    rows = _requests(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("key"), "seq", "now", F.when(s % 23 == 0, "open").when(s % 29 == 0, "down").otherwise("ok").alias("backend"), F.when(s % 5 == 0, "nothing").when(s % 7 == 0, "corrupt").otherwise("value").alias("found"))
    return state.cache_replay(rows, ttl_s=14_400.0, negative_ttl_s=3600.0)


# Stores


@query("x1_ingest", fx.with_("batch", then="").rstrip() + f""", {act.BAD}, stored AS (SELECT 'event-00000' || printf('%03d', n) AS event_id FROM (SELECT unnest(range(1000)) AS n)),
ready AS (SELECT coalesce(event_id, sha256(request_id || ':' || "index")) AS event_id, event_type, item_id, request_id, {hmac_sql(KEY, 'user_id')} AS user_id_hash FROM batch WHERE request_id IN (SELECT request_id FROM bad WHERE first_bad IS NULL) AND event_type IN ('impression', 'click', 'conversion'))
SELECT * FROM ready WHERE event_id NOT IN (FROM stored)""")
def x1_ingest(spark, sf_dir):
    """Batches inside the window, hashed, with ids, first of each id, into a store that holds some already."""
    rows = events.prepare(fx.event_batch(spark, sf_dir), KEY, act.KEY_VERSION, fx.now())
    rows = rows.filter(F.col("event_type").isin(*events.EVENT_TYPES))
    stored = spark.range(1000).select(F.format_string("event-%08d", "id").alias("event_id"))
    return events.insert_ignore(stored, rows, "event_id", ["index"]).select("event_id", "event_type", "item_id", "request_id", "user_id_hash")


@query("x4_write_exposures", f"""WITH {act.ASSIGNED},
asked AS (SELECT *, 'r' || (CAST(user_id AS BIGINT) // 2) AS request_id, CAST(user_id AS BIGINT) AS seq, sha256('exposure:' || experiment || ':r' || (CAST(user_id AS BIGINT) // 2)) AS event_id FROM assigned),
numbered AS (SELECT *, row_number() OVER (PARTITION BY event_id, log_exposure ORDER BY seq) AS nth, seq // 2 % 7 = 0 AS stored FROM asked)
SELECT event_id, experiment, request_id, log_exposure AND nth = 1 AND NOT stored AS inserted, CASE WHEN NOT log_exposure THEN 'log_exposure_false' WHEN stored OR nth > 1 THEN 'duplicate' END AS skipped_reason FROM numbered""")
def x4_write_exposures(spark, sf_dir):
    """Two users share a request, and some requests are in the store."""
    request = F.floor(F.col("user_id").cast("long") / 2)
    rows = act._assigned(spark, sf_dir).withColumn("request_id", F.concat(F.lit("r"), request.cast("string"))).withColumn("seq", F.col("user_id").cast("long"))
    stored = experiments.exposures(rows.filter(request % 7 == 0)).select("event_id").distinct()
    return experiments.write_exposures(stored, rows)


SPOILT = f"""WITH {act.ASSIGNED},
asked AS (SELECT * REPLACE (CASE WHEN experiment = 'layout' AND CAST(user_id AS BIGINT) % 3 = 0 THEN NULL ELSE variant END AS variant), 'r' || user_id AS request_id FROM assigned)"""


def _spoilt(spark, sf_dir):
    """Assignments of which one experiment loses some variants."""
    lost = (F.col("experiment") == "layout") & (F.col("user_id").cast("long") % 3 == 0)
    rows = act._assigned(spark, sf_dir).withColumn("variant", F.when(~lost, F.col("variant")))
    return rows.withColumn("request_id", F.concat(F.lit("r"), "user_id")).withColumn("seq", F.col("user_id").cast("long"))


@query("x5_independent_failures", f"{SPOILT} SELECT experiment, CASE WHEN NOT log_exposure THEN 'log_exposure_false' WHEN variant IS NULL THEN 'failed' ELSE 'inserted' END AS outcome, count(*) AS n FROM asked GROUP BY ALL")
def x5_independent_failures(spark, sf_dir):
    """Exposures of one experiment that cannot be written keep no other from being written."""
    rows = _spoilt(spark, sf_dir)
    found = experiments.write_exposures(rows.limit(0).select(F.lit("").alias("event_id")), rows)
    return found.groupBy("experiment", F.when(F.col("inserted"), "inserted").otherwise(F.col("skipped_reason")).alias("outcome")).agg(F.count("*").alias("n"))


@query("x5_first_reported", f"{SPOILT} SELECT request_id, experiment, variant FROM asked WHERE experiment = 'layout'")
def x5_first_reported(spark, sf_dir):
    """The experiment declared first is the one a response names, written or not."""
    return experiments.first_reported(_spoilt(spark, sf_dir), ["layout", "ranker", "gap", "old"])


#: Experiments by user, wrong in several ways: names and salts that repeat, floored percentages, variants by another's name, stops without a time.
DEFINED = """definition AS (
  SELECT 'e' || (user_id // 2) AS name, 's' || (user_id % 101) AS salt, CASE WHEN user_id % 5 = 0 THEN 'stopped' ELSE 'running' END AS status, v, list_concat([p[1] + CASE WHEN user_id % 3 > 0 THEN 100 - list_sum(p) ELSE 0 END], p[2:]) AS p, CASE WHEN user_id % 10 = 0 OR user_id % 8 = 1 THEN last END AS stopped_at FROM (
    SELECT user_id, max(last) AS last, list(CASE WHEN user_id % 7 = 0 AND event_type = 'error' THEN 'view' ELSE event_type END ORDER BY event_type) AS v, list(100 * n // total ORDER BY event_type) AS p
    FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS last, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY user_id, event_type) GROUP BY user_id))"""


def _definitions(spark, sf_dir):
    u = F.col("user_id")
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    each = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    users = counts.groupBy("user_id").agg(each.alias("each"), F.sum("n").alias("total"), F.max("last").alias("last"))
    share = lambda e: F.floor(100 * e["n"] / F.col("total")).cast("int")
    users = users.withColumn("rest", F.when(u % 3 > 0, 100 - F.aggregate("each", F.lit(0), lambda s, e: s + share(e))).otherwise(0))
    variant = lambda e: F.when((u % 7 == 0) & (e["event_type"] == "error"), "view").otherwise(e["event_type"])
    allocation = F.transform("each", lambda e, i: F.struct(variant(e).alias("variant"), (share(e) + F.when(i == 0, F.col("rest")).otherwise(0)).alias("pct")))
    stopped_at = F.when((u % 10 == 0) | (u % 8 == 1), F.col("last").cast("string"))
    return users.select(F.concat(F.lit("e"), F.floor(u / 2).cast("string")).alias("name"), F.concat(F.lit("s"), (u % 101).cast("string")).alias("salt"), F.when(u % 5 == 0, "stopped").otherwise("running").alias("status"), allocation.alias("allocation"), stopped_at.alias("stopped_at"))


@query("s15_invalid_experiments", f"""WITH {DEFINED}
SELECT name, CASE WHEN list_sum(p) <> 100 THEN 'allocation does not sum to 100' WHEN len(list_distinct(v)) < len(v) THEN 'repeated variant' ELSE 'stopped_at must be set exactly for stopped experiments' END AS reason FROM definition WHERE list_sum(p) <> 100 OR len(list_distinct(v)) < len(v) OR (status = 'stopped') <> (stopped_at IS NOT NULL)
UNION ALL SELECT min(name), 'repeated name' FROM definition GROUP BY name HAVING count(*) > 1 UNION ALL SELECT min(name), 'repeated salt' FROM definition GROUP BY salt HAVING count(*) > 1""")
def s15_invalid_experiments(spark, sf_dir):
    return experiments.invalid_experiments(_definitions(spark, sf_dir))


# Counters


@query("a16_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY 1")
def a16_latency_percentiles(spark, sf_dir):
    rows = events.latency_percentiles(table(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")


#: Upper bounds of the latency histogram in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


@query("a20_histogram", f"SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (value / 1000 <= le) AS n FROM events, (SELECT unnest({list(LATENCY_BOUNDS)}::DOUBLE[]) AS le) GROUP BY ALL")
def a20_histogram(spark, sf_dir):
    """Cumulative buckets of values read as milliseconds."""
    return events.histogram(table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 1000), "seconds", LATENCY_BOUNDS, "event_type")


@query("a19_counters", "SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY ALL")
def a19_counters(spark, sf_dir):
    return events.outcome_counts(table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 3), "event_type", "shard")


# Statistics


@query("ext_srm", f"WITH {act.ASSIGNED}, c AS (SELECT experiment, sum((n - e) * (n - e) / e) AS chi2, count(*) - 1 AS df FROM (SELECT experiment, variant, count(*) AS n FROM assigned WHERE experiment IN ('ranker', 'tilted') GROUP BY ALL) JOIN (SELECT experiment, variant, pct / 100.0 * (SELECT count(*) FROM person) AS e FROM allocation) USING (experiment, variant) GROUP BY 1) SELECT experiment, round(chi2, 6) AS chi2, df, round(exp(-chi2 / 2), 6) AS p_value, exp(-chi2 / 2) < 0.001 AS alert FROM c")
def ext_srm(spark, sf_dir):
    """Sample-ratio mismatch of the running experiment; with three variants the tail is an exponential."""
    counts = act._assigned(spark, sf_dir).filter("experiment = 'ranker'").groupBy("experiment", "variant").agg(F.count("*").alias("n"))
    shares = fx.experiments(spark).select(F.col("name").alias("experiment"), F.explode("allocation").alias("a")).select("experiment", "a.variant", "a.pct")
    return statistics.sample_ratio(counts, shares).select("experiment", F.round("chi2", 6).alias("chi2"), "df", F.round("p_value", 6).alias("p_value"), "alert")


ARMS = "g AS (SELECT user_id % 2 AS arm, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits FROM events GROUP BY 1), s AS (SELECT a.n AS n0, b.n AS n1, a.hits / a.n AS p0, b.hits / b.n AS p1, (a.hits + b.hits) / (a.n + b.n) AS p FROM g a, g b WHERE a.arm = 0 AND b.arm = 1)"


@query("ext_two_proportions", f"WITH {ARMS}, t AS (SELECT *, sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1) AS e FROM s) SELECT round((p1 - p0) / sqrt(p * (1 - p) * (1 / n0 + 1 / n1)), 6) AS z, round(p1 - p0, 6) AS difference, round(p1 - p0 - 1.959964 * e, 6) AS low, round(p1 - p0 + 1.959964 * e, 6) AS high FROM t")
def ext_two_proportions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "purchase").alias("hit"))
    return statistics.two_proportions(rows, "arm", "hit").select(*[F.round(c, 6).alias(c) for c in ("z", "difference", "low", "high")])


#: For each third of the users and event type, how many of 40 groups of users have a mean value as high as the first group's.
RANKED = "WITH g AS (SELECT 'third ' || (user_id % 3) AS family, event_type, user_id % 40 AS arm, avg(value) AS m FROM events GROUP BY ALL), own AS (SELECT family, event_type, m AS own FROM g WHERE arm = (SELECT min(arm) FROM g x WHERE x.family = g.family AND x.event_type = g.event_type)), p AS (SELECT family, event_type, count(*) FILTER (m >= own) / 41 AS p FROM g JOIN own USING (family, event_type) GROUP BY ALL)"


@query("ext_holm", f"{RANKED}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY family) AS m FROM p WINDOW w AS (PARTITION BY family ORDER BY p, event_type)) SELECT family, event_type, p, bool_and(p <= 0.3 / (m - i + 1)) OVER (PARTITION BY family ORDER BY p, event_type) AS rejected FROM r")
def ext_holm(spark, sf_dir):
    """Randomisation p-values of every event type, corrected within thirds of the users."""
    g = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("third "), (F.col("user_id") % 3).cast("string")).alias("family"), "event_type", (F.col("user_id") % 40).alias("arm")).agg(statistics.exact_mean("value").alias("m"))
    own = g.groupBy("family", "event_type").agg(F.min_by("m", "arm").alias("own"))
    p = g.join(own, ["family", "event_type"]).groupBy("family", "event_type").agg((F.count_if(F.col("m") >= F.col("own")) / 41).alias("p"))
    return statistics.holm(p, "family", "event_type", "p", 0.3)


@query("ext_sample_size", "SELECT event_type, effect, CAST(ceil(pow(1.959964 + 0.841621, 2) * (base * (1 - base) + (base + effect) * (1 - base - effect)) / (effect * effect)) AS BIGINT) AS n FROM (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS base FROM events GROUP BY 1), (SELECT unnest([0.005, 0.01, 0.02]::DOUBLE[]) AS effect)")
def ext_sample_size(spark, sf_dir):
    """Rows per arm to see each event type's share change."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).select("event_type", (F.col("n") / F.col("total")).alias("base"), F.explode(F.array(*map(F.lit, (0.005, 0.01, 0.02)))).alias("effect"))
    return rows.select("event_type", "effect", statistics.sample_size(F.col("base"), F.col("effect")).alias("n"))


@query("ext_guardrails", "SELECT variant, n, round(error_rate, 6) AS error_rate, round(p95, 6) AS p95, error_rate > 0.2 OR p95 > 190 AS breached FROM (SELECT user_id % 3 AS variant, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)")
def ext_guardrails(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("variant"), (F.col("event_type") == "error").alias("failed"), "value")
    found = statistics.guardrails(rows, "variant", "failed", "value", {"error_rate": 0.2, "p95": 190.0})
    return found.withColumns({c: F.round(c, 6) for c in ("error_rate", "p95")})


@query("ext_psi", "WITH e AS (SELECT min(value) AS low, max(value) AS high FROM events), b AS (SELECT CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS period, least(CAST(floor((value - low) / (high - low) * 10) AS INTEGER), 9) AS bin FROM events, e), c AS (SELECT bin, count(*) FILTER (period = 0) AS a, count(*) FILTER (period = 1) AS z FROM b GROUP BY 1), s AS (SELECT greatest(a / sum(a) OVER (), 1e-4) AS p, greatest(z / sum(z) OVER (), 1e-4) AS q FROM c) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s")
def ext_psi(spark, sf_dir):
    """Stability of a value between the halves of the month."""
    rows = table(spark, sf_dir, "events").select((F.dayofmonth("ts") > 15).cast("int").alias("period"), "value")
    return statistics.stability_index(rows, "period", "value").select(F.round("psi", 6).alias("psi"))


def _burn_sql(hours: str) -> str:
    return f"coalesce(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FILTER (age >= 0 AND age < {hours}) / 0.005, 0)"


@query("ext_burn_alerts", "SELECT w AS window_hours, round(l, 6) AS long_burn, round(s, 6) AS short_burn, l >= r AND s >= r AS fires FROM (" + " UNION ALL ".join(f"SELECT {long}::DOUBLE AS w, {_burn_sql(str(long))} AS l, {_burn_sql(repr(short))} AS s, {rate} AS r FROM (SELECT event_type, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600e6 AS age FROM events)" for long, short, rate in statistics.BURN_ALERTS) + ")")
def ext_burn_alerts(spark, sf_dir):
    """Burn of a 99.5 % availability budget in three pairs of windows."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = statistics.burn_alerts(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed")), "ts", "failed", now)
    return rows.withColumns({c: F.round(c, 6) for c in ("long_burn", "short_burn")})


SCORED = "SELECT (user_id * 37 % 101) / 101 AS score, CASE WHEN event_type = 'purchase' OR user_id % 7 = 0 THEN 1 ELSE 0 END AS label FROM events"


def _scored(spark, sf_dir):
    label = ((F.col("event_type") == "purchase") | (F.col("user_id") % 7 == 0)).cast("int")
    return table(spark, sf_dir, "events").select((F.col("user_id") * 37 % 101 / 101).alias("score"), label.alias("label"))


@query("ext_calibration", f"SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS rate FROM ({SCORED}) GROUP BY 1")
def ext_calibration(spark, sf_dir):
    return statistics.calibration(_scored(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_score", "rate")})


@query("ext_auc", f"WITH s AS ({SCORED}), g AS (SELECT score, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM s GROUP BY 1) SELECT round(sum(x.a * y.b * CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / (SELECT sum(a) * sum(b) FROM g), 6) AS auc FROM g x, g y")
def ext_auc(spark, sf_dir):
    return statistics.area_under_curve(_scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


# Churn and drift as their own figures would be watched


CUTOFFS = {"train": [datetime(2024, 1, 11), datetime(2024, 1, 14), datetime(2024, 1, 17)], "validation": [datetime(2024, 1, 21)], "test": [datetime(2024, 1, 26)]}
LOOKBACK_DAYS, HORIZON_HOURS = 10, 24


def _examples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("kind"), "value")
    return churn.split_by_time(rows, CUTOFFS, LOOKBACK_DAYS, HORIZON_HOURS)


def _examples_sql() -> str:
    cutoffs = ", ".join(f"('{s}', TIMESTAMP '{c}')" for s, cs in CUTOFFS.items() for c in cs)
    n, late = "count(*) FILTER (ts < cutoff)", f"count(*) FILTER (ts < cutoff AND ts >= cutoff - INTERVAL {LOOKBACK_DAYS * 12} HOUR)"
    return f"""SELECT split, cutoff, user_id, round((epoch_us(cutoff) - epoch_us(max(ts) FILTER (ts < cutoff))) / 86400e6, 6) AS recency_days, CAST({n} AS DOUBLE) AS events, CAST(count(DISTINCT CAST(ts AS DATE)) FILTER (ts < cutoff) AS DOUBLE) AS active_days,
  CAST(count(DISTINCT event_type) FILTER (ts < cutoff) AS DOUBLE) AS kinds, round(coalesce(avg(value) FILTER (ts < cutoff), 0), 10) AS value, round((2 * {late} - {n}) / greatest({n}, 1), 6) AS trend, CAST(count(*) FILTER (ts >= cutoff) = 0 AS INTEGER) AS label
FROM events, (VALUES {cutoffs}) c(split, cutoff) WHERE ts >= cutoff - INTERVAL {LOOKBACK_DAYS} DAY AND ts < cutoff + INTERVAL {HORIZON_HOURS} HOUR GROUP BY split, cutoff, user_id HAVING {n} > 0"""


@query("ext_churn_splits", _examples_sql())
def ext_churn_splits(spark, sf_dir):
    """Features and labels of users at cutoffs in time, by split."""
    return _examples(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in (("recency_days", 6), ("value", 10), ("trend", 6))})


@query("ext_churn_model")
def ext_churn_model(spark, sf_dir):
    """AUC and Brier score of both models on the validation and test splits, and which one validation chooses."""
    return churn.evaluate(churn.fit_and_score(_examples(spark, sf_dir)))


@query("ext_churn_reliability")
def ext_churn_reliability(spark, sf_dir):
    """Reliability of the chosen model on the test split."""
    scores = churn.fit_and_score(_examples(spark, sf_dir))
    return churn.reliability(scores, churn.evaluate(scores))


@query("ext_psi_components")
def ext_psi_components(spark, sf_dir):
    """Stability of vectors on the first five components of the reference half: even ids before, odd ids now."""
    return drift.component_drift(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("period"), "embedding"), "period", "embedding").withColumn("psi", F.round("psi", 6))


AXES = 8


@query("ext_psi_axes", f"""
WITH score AS (SELECT vec_id % 2 AS period, c AS component, CAST(embedding[c] AS DOUBLE) AS score FROM embeddings, (SELECT unnest(range(1, {AXES + 1})) AS c) WHERE embedding IS NOT NULL),
edge AS (SELECT component, unnest(quantile_cont(score, [i / 10 for i in range(1, 10)])) AS e FROM score WHERE period = 0 GROUP BY 1),
bin AS (SELECT period, s.component, (SELECT count(*) FROM edge WHERE edge.component = s.component AND s.score >= e) AS bin FROM score s),
n AS (SELECT g.component, g.bin, count(*) FILTER (period = 0) AS a, count(*) FILTER (period = 1) AS b FROM (SELECT DISTINCT component, x AS bin FROM edge, (SELECT unnest(range(10)) AS x)) g LEFT JOIN bin USING (component, bin) GROUP BY ALL),
share AS (SELECT component, greatest(a / sum(a) OVER w, 1e-4) AS p, greatest(b / sum(b) OVER w, 1e-4) AS q FROM n WINDOW w AS (PARTITION BY component))
SELECT CAST(component AS INTEGER) AS component, round(sum((q - p) * ln(q / p)), 6) AS psi FROM share GROUP BY 1""")
def ext_psi_axes(spark, sf_dir):
    """The same with the first coordinates as axes, which SQL can follow: shared quantile bins for each."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select((F.col("vec_id") % 2).cast("int").alias("period"), F.posexplode(F.slice("embedding", 1, AXES)).alias("at", "x"))
    return drift.stability(rows.select("period", (F.col("at") + 1).alias("component"), F.col("x").cast("double").alias("score"))).withColumn("psi", F.round("psi", 6))
