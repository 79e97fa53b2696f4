"""Events, experiments, state machines and extensions over the activity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaline.functions import hashing
from tessaline.operators import events, experiments, statistics
from tessaline.plans import fixtures as fx
from tessaline.plans.registry import query
from tessaline.session import table
from tessaline.streaming import state

KEY, KEY_VERSION = b"test-salt", 1
IN_WINDOW = f"(epoch_us(TIMESTAMP '{fx.NOW}') - epoch_us(event_ts)) / 1e6 BETWEEN -300 AND 604800"
BAD = f"bad AS (SELECT request_id, min(\"index\") FILTER (NOT ({IN_WINDOW})) AS first_bad FROM batch GROUP BY 1)"


@query("p7_skew_window", fx.with_("batch", then=f"SELECT {IN_WINDOW} AS accepted, count(*) AS n FROM batch GROUP BY 1"))
def p7_skew_window(spark, sf_dir):
    return fx.event_batch(spark, sf_dir).groupBy(events.in_window(F.col("event_ts"), fx.now()).alias("accepted")).agg(F.count("*").alias("n"))


@query("p7_first_violation", fx.with_("batch", then="").rstrip() + f", {BAD} SELECT * FROM bad")
def p7_first_violation(spark, sf_dir):
    return events.first_violation(fx.event_batch(spark, sf_dir), fx.now())


@query("p12_envelope", fx.with_("batch", then="SELECT (event_id IS NULL OR length(event_id) BETWEEN 8 AND 64) AND event_type IN ('impression', 'click', 'conversion') AND position >= 1 AS valid, count(*) AS n FROM batch GROUP BY 1"))
def p12_envelope(spark, sf_dir):
    return fx.event_batch(spark, sf_dir).groupBy(events.valid_envelope().alias("valid")).agg(F.count("*").alias("n"))


@query("f16_event_ids", fx.with_("batch", then="""SELECT request_id, "index", coalesce(event_id, sha256(request_id || ':' || "index")) AS event_id FROM batch"""))
def f16_event_ids(spark, sf_dir):
    made = hashing.event_id(F.col("request_id"), F.col("index"))
    return fx.event_batch(spark, sf_dir).select("request_id", "index", F.coalesce("event_id", made).alias("event_id"))


def _twice(spark, sf_dir):
    """A batch with every third event repeated."""
    rows = fx.event_batch(spark, sf_dir).filter("event_id IS NOT NULL")
    return rows.withColumn("copy", F.lit(0)).unionByName(rows.filter("position % 3 = 0").withColumn("copy", F.lit(1)))


TWICE = "twice AS (SELECT *, 0 AS copy FROM batch WHERE event_id IS NOT NULL UNION ALL SELECT *, 1 FROM batch WHERE event_id IS NOT NULL AND position % 3 = 0), stored AS (SELECT event_id FROM batch WHERE position = 5 AND event_id IS NOT NULL)"


@query("d6_insert_ignore", fx.with_("batch", then="").rstrip() + f", {TWICE} SELECT event_id, copy FROM twice WHERE copy = 0 AND event_id NOT IN (FROM stored)")
def d6_insert_ignore(spark, sf_dir):
    stored = fx.event_batch(spark, sf_dir).filter("position = 5 AND event_id IS NOT NULL").select("event_id")
    return events.insert_ignore(stored, _twice(spark, sf_dir), "event_id", ["copy"]).select("event_id", "copy")


@query("a14_accounting", fx.with_("batch", then="").rstrip() + f", {TWICE} SELECT count(*) FILTER (new) AS accepted, count(*) FILTER (NOT new) AS duplicates, 0::BIGINT AS rejected FROM (SELECT copy = 0 AND event_id NOT IN (FROM stored) AS new FROM twice)")
def a14_accounting(spark, sf_dir):
    stored = fx.event_batch(spark, sf_dir).filter("position = 5 AND event_id IS NOT NULL").select("event_id")
    batch = _twice(spark, sf_dir)
    return events.accounting(batch, events.insert_ignore(stored, batch, "event_id", ["copy"]))


BUCKET = """list_reduce(list_prepend(0::HUGEINT, list_transform(range(8), lambda i: CAST(CAST('0x' || substr(sha256('test:' || salt || ':' || user_id), CAST(i * 8 + 1 AS INTEGER), 8) AS BIGINT) AS HUGEINT))), lambda a, x: (a * 4294967296 + x) % 10000)"""
ASSIGNED = f"""allocation(experiment, salt, status, variant, pct, n) AS (VALUES ('ranker', 'salt-a', 'running', 'control', 50, 1), ('ranker', 'salt-a', 'running', 'blend', 30, 2), ('ranker', 'salt-a', 'running', 'mmr', 20, 3),
  ('layout', 'salt-b', 'paused', 'off', 50, 1), ('layout', 'salt-b', 'paused', 'on', 50, 2), ('gap', 'salt-c', 'running', 'a', 40, 1), ('gap', 'salt-c', 'running', 'b', 20, 2), ('old', 'salt-d', 'stopped', 'x', 100, 1)),
bound AS (SELECT *, sum(pct) OVER (PARTITION BY experiment ORDER BY n) * 100 AS hi FROM allocation),
person AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer),
bucketed AS (SELECT user_id, experiment, status, control, CAST({BUCKET} AS INTEGER) AS bucket FROM person, (SELECT experiment, salt, status, min_by(variant, n) AS control FROM allocation GROUP BY ALL)),
assigned AS (
  SELECT k.user_id, k.experiment, bucket, CASE WHEN k.status = 'running' AND b.variant IS NOT NULL THEN b.variant ELSE control END AS variant,
         CASE WHEN k.status <> 'running' THEN k.status WHEN b.variant IS NULL THEN 'allocation_gap' END AS fallback_reason, k.status <> 'stopped' AS log_exposure
  FROM bucketed k LEFT JOIN bound b ON k.experiment = b.experiment AND bucket >= hi - pct * 100 AND bucket < hi)"""


def _assigned(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return experiments.assign(users, fx.experiments(spark), "test")


@query("x2_x3_x5_assignment", f"WITH {ASSIGNED} SELECT * FROM assigned")
def x2_assignment(spark, sf_dir):
    """Every user in every experiment: buckets, variants, gaps, paused and stopped."""
    return _assigned(spark, sf_dir)


@query("x4_f17_exposures", f"WITH {ASSIGNED} SELECT sha256('exposure:' || experiment || ':r' || user_id) AS event_id, experiment, variant FROM assigned WHERE log_exposure")
def x4_exposures(spark, sf_dir):
    rows = _assigned(spark, sf_dir).withColumn("request_id", F.concat(F.lit("r"), "user_id"))
    return experiments.exposures(rows).select("event_id", "experiment", "variant")


@query("w6_cumulative_allocation", "WITH share AS (SELECT 'g' || (user_id % 25) AS experiment, event_type AS variant, CAST(100 * count(*) // sum(count(*)) OVER (PARTITION BY user_id % 25) AS INTEGER) AS pct FROM events GROUP BY user_id % 25, event_type), bound AS (SELECT *, sum(pct) OVER (PARTITION BY experiment ORDER BY variant) * 100 AS hi FROM share) SELECT experiment, variant, CAST(hi - pct * 100 AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM bound")
def w6_cumulative_allocation(spark, sf_dir):
    """Buckets of experiments that are allocated by the events of groups of users."""
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("g"), "event_type").agg(F.count("*").alias("n"))
    groups = counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("each"), F.sum("n").alias("total"))
    allocation = F.transform("each", lambda e: F.struct(e["event_type"].alias("variant"), F.floor(100 * e["n"] / F.col("total")).cast("int").alias("pct")))
    rows = groups.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("experiment"), F.explode(experiments.with_bounds(allocation)).alias("b"))
    return rows.select("experiment", "b.variant", "b.lo", "b.hi")


@query("st7_late_policy", fx.with_("batch", then=f"SELECT CASE WHEN {IN_WINDOW} THEN 'kept' WHEN event_ts > TIMESTAMP '{fx.NOW}' THEN 'future' ELSE 'late' END AS outcome, count(*) AS n FROM batch GROUP BY 1"))
def st7_late_policy(spark, sf_dir):
    outcome = F.when(events.in_window(F.col("event_ts"), fx.now()), "kept").when(F.col("event_ts") > fx.now(), "future").otherwise("late")
    return fx.event_batch(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("st9_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st9_windowed_counts(spark, sf_dir):
    rows = state.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_sessions", """WITH s AS (SELECT user_id, ts, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200 * 1000000::BIGINT AS INTEGER), 0) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end", count(*) AS n FROM n GROUP BY user_id, session""")
def st_sessions(spark, sf_dir):
    rows = state.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 43_200)
    return rows.withColumns({c: F.unix_micros(c) for c in ("start", "end")})






@query("f19_age_days", f"SELECT event_id, round(greatest(0, (epoch_us(TIMESTAMP '{fx.NOW}') - epoch_us(ts)) / 86400e6), 6) AS age FROM events")
def f19_age_days(spark, sf_dir):
    from tessaline.functions.vectors import age_days

    return table(spark, sf_dir, "events").select("event_id", F.round(age_days(fx.now(), F.col("ts").cast("timestamp")), 6).alias("age"))


# Extensions: specified for the engine but beyond its core.


@query("ext_welch", "WITH g AS (SELECT user_id % 2 AS arm, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1) SELECT round((b.m - a.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM g a, g b WHERE a.arm = 0 AND b.arm = 1")
def ext_welch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("arm"), "value")
    return statistics.welch(rows, "arm", "value").select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("ext_welch_interval")
def ext_welch_interval(spark, sf_dir):
    """The same comparison with its p-value and the interval of the difference."""
    return statistics.welch(table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("arm"), "value"), "arm", "value")


@query("ext_event_popularity", fx.with_("batch", then="SELECT item_id, CAST(count(*) AS DOUBLE) AS popularity FROM batch WHERE event_type IN ('impression', 'click', 'conversion') GROUP BY 1"))
def ext_event_popularity(spark, sf_dir):
    rows = fx.event_batch(spark, sf_dir).filter(F.col("event_type").isin(*events.EVENT_TYPES))
    return rows.groupBy("item_id").agg(F.count("*").cast("double").alias("popularity"))


@query("ext_retention", f"SELECT days, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{fx.NOW}' - to_days(days)) AS kept FROM (SELECT unnest([14, 365]) AS days)")
def ext_retention(spark, sf_dir):
    """Events of the last fourteen days, and of a year; the filter reaches the scan."""
    now = F.lit(fx.NOW).cast("timestamp_ntz")
    out = None
    for days in (14, 365):
        one = events.retained(table(spark, sf_dir, "events"), "ts", now, days).agg(F.lit(days).alias("days"), F.count("*").alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ext_churn_features", f"SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, round(sum(value), 4) AS total, CAST(floor((epoch_us(TIMESTAMP '{fx.NOW}') - epoch_us(max(ts))) / 86400e6) AS BIGINT) AS idle_days, max(ts) < TIMESTAMP '{fx.NOW}' - INTERVAL 3 DAY AS churned FROM events GROUP BY 1")
def ext_churn_features(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id")
    idle = (F.unix_micros(fx.now()) - F.unix_micros(F.max("ts"))) / 86_400e6
    return rows.agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.round(F.sum("value"), 4).alias("total"), F.floor(idle).alias("idle_days"), (F.max("ts") < fx.now() - F.expr("INTERVAL 3 DAYS")).alias("churned"))
