"""Predicates, scalar functions, set operations and small machines over rows on which a wrong rule shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaline.functions import hashing, text, vectors
from tessaline.operators import events, experiments, rerank, sets
from tessaline.plans import fixtures as fx
from tessaline.plans import retrieval as rt
from tessaline.plans.registry import query
from tessaline.session import table
from tessaline.sources import files
from tessaline.streaming import state

KEY = b"test-salt"


def pick(values: list[str | None], number):
    """The value at a number modulo their count."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: list[str | None], number: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({number} % {len(values)} AS INTEGER) + 1]"


# Predicates


SPOILT = """spoilt AS (
  SELECT item_id, vec_id, CASE vec_id % 11 WHEN 1 THEN vector[1:63] WHEN 2 THEN list_prepend('nan'::DOUBLE, vector[2:]) WHEN 3 THEN list_transform(vector, lambda x: x * 1.01) WHEN 4 THEN list_prepend('inf'::DOUBLE, vector[2:]) ELSE vector END AS embedding FROM item
  UNION ALL SELECT item_id, vec_id, vector FROM item WHERE vec_id % 13 = 0)"""


def _spoilt(spark, sf_dir):
    """Items, some with vectors that are too short, not finite or too long, and some twice."""
    rows = fx.items(spark, sf_dir).select("item_id", "vec_id", F.col("vector").cast("array<double>").alias("v"))
    n, v = F.col("vec_id") % 11, F.col("v")
    first = lambda x: F.concat(F.array(F.lit(float(x))), F.slice(v, 2, 63))
    bad = F.when(n == 1, F.slice(v, 1, 63)).when(n == 2, first("nan")).when(n == 3, F.transform(v, lambda x: x * 1.01)).when(n == 4, first("inf")).otherwise(v)
    return rows.select("item_id", "vec_id", bad.alias("embedding")).unionByName(rows.filter("vec_id % 13 = 0").select("item_id", "vec_id", v.alias("embedding")))


@query("p8_invalid_embeddings", fx.with_("item", then="").rstrip() + f""", {SPOILT}
SELECT item_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not finite' ELSE 'norm' END AS reason FROM spoilt
WHERE len(embedding) <> 64 OR len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 OR abs(sqrt(list_inner_product(embedding, embedding)) - 1) > 1e-4
UNION ALL SELECT item_id, 'repeated' FROM spoilt GROUP BY item_id HAVING count(*) > 1""")
def p8_invalid_embeddings(spark, sf_dir):
    return files.invalid_embeddings(_spoilt(spark, sf_dir), 64)


@query("p9_valid_queries", fx.with_("item", then="").rstrip() + f""", {SPOILT}
SELECT item_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND coalesce(abs(sqrt(list_inner_product(list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END), list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END))) - 1) <= 1e-3, false) AS valid FROM spoilt""")
def p9_valid_queries(spark, sf_dir):
    from tessaline.operators.search import valid_query

    return _spoilt(spark, sf_dir).select("item_id", valid_query(F.col("embedding")).alias("valid"))


@query("p10_candidate_validity", rt._with_candidates("""
, spoilt AS (SELECT query_id, CASE WHEN n % 7 = 1 THEN '' ELSE item_id END AS item_id, CASE WHEN n % 7 = 2 THEN 'nan'::DOUBLE ELSE score END AS score,
  CASE WHEN n % 7 = 3 THEN 'inf'::DOUBLE ELSE popularity END AS popularity, CASE WHEN n % 7 = 4 THEN -1 WHEN n % 7 = 5 THEN NULL ELSE age_days END AS age_days
  FROM (SELECT *, CAST(substr(item_id, 3) AS BIGINT) AS n FROM candidate))
SELECT query_id, count(*) AS n, count(*) FILTER (item_id <> '' AND NOT isnan(score) AND NOT isinf(score) AND NOT isnan(popularity) AND NOT isinf(popularity) AND age_days >= 0) AS valid FROM spoilt GROUP BY 1"""))
def p10_candidates(spark, sf_dir):
    n = F.substring("item_id", 3, 20).cast("long") % 7
    rows = rt._candidates(spark, sf_dir).withColumn("n", n)
    rows = rows.select("query_id", F.when(F.col("n") == 1, "").otherwise(F.col("item_id")).alias("item_id"), F.when(F.col("n") == 2, float("nan")).otherwise(F.col("score")).alias("score"), F.when(F.col("n") == 3, float("inf")).otherwise(F.col("popularity")).alias("popularity"), F.when(F.col("n") == 4, -1.0).when(F.col("n") != 5, F.col("age_days")).alias("age_days"))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(rerank.valid_candidate(), 1)).alias("valid"))


@query("p11_request_bounds", "SELECT c_custkey, length(u) BETWEEN 1 AND 128 AND seeds <= 50 AND k BETWEEN 1 AND 100 AS valid FROM (SELECT c_custkey, repeat('u', CAST(c_custkey % 140 AS INTEGER)) AS u, c_custkey % 53 AS seeds, c_custkey % 103 AS k FROM customer)")
def p11_request_bounds(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", sets.valid_request(F.repeat(F.lit("u"), (n % 140).cast("int")), n % 53, n % 103).alias("valid"))


@query("p12_batches", fx.with_("batch", then="""SELECT request_id, n, n BETWEEN 1 AND 100 AND sound AS valid FROM (SELECT request_id, count(*) AS n, bool_and(coalesce((event_id IS NULL OR length(event_id) BETWEEN 8 AND 64) AND event_type IN ('impression', 'click', 'conversion') AND position >= 1, false)) AS sound FROM (
  SELECT CASE WHEN CAST(substr(request_id, 2) AS BIGINT) < 12 THEN 'large' ELSE request_id END AS request_id, event_id, event_type, position FROM batch WHERE request_id IN ('r0', 'r1', 'r2') OR event_type IN ('click', 'impression') AND position >= 1) GROUP BY 1)"""))
def p12_batches(spark, sf_dir):
    rows = fx.event_batch(spark, sf_dir).filter("request_id IN ('r0', 'r1', 'r2') OR event_type IN ('click', 'impression') AND position >= 1")
    large = F.substring("request_id", 2, 20).cast("long") < 12
    return events.valid_batches(rows.withColumn("request_id", F.when(large, "large").otherwise(F.col("request_id"))))


HEX = "regexp_matches(h, '^[0-9a-f]{64}$')"


@query("p13_row_checks", f"""SELECT event_id, {HEX} AND kind IN ('impression', 'click', 'conversion') AND (position IS NULL OR position >= 1) AND (name IS NULL) = (variant IS NULL) AS valid FROM (
  SELECT event_id, CASE event_id % 5 WHEN 1 THEN upper(sha256(CAST(user_id AS VARCHAR))) WHEN 2 THEN substr(sha256(CAST(user_id AS VARCHAR)), 2) ELSE sha256(CAST(user_id AS VARCHAR)) END AS h, CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'conversion' ELSE event_type END AS kind,
    CASE WHEN event_id % 7 <> 3 THEN event_id % 7 END AS position, CASE WHEN event_id % 3 > 0 THEN 'e' END AS name, CASE WHEN event_id % 4 > 0 THEN 'v' END AS variant FROM events)""")
def p13_row_checks(spark, sf_dir):
    e = F.col("event_id")
    whole = hashing.sha256(F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "purchase", "conversion").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 5 == 1, F.upper(whole)).when(e % 5 == 2, F.substring(whole, 2, 64)).otherwise(whole).alias("user_id_hash"), kind.alias("event_type"), F.when(e % 7 != 3, e % 7).alias("position"),
        F.when(e % 3 > 0, "e").alias("experiment_name"), F.when(e % 4 > 0, "v").alias("experiment_variant"),
    )
    return rows.select("event_id", events.valid_row().alias("valid"))


REASONS = ["disabled", "stopped", "paused", "allocation_gap", None, "other", ""]


@query("p13_exposure_checks", f"SELECT c_custkey, (c_custkey % 11 - 1) * 1001 BETWEEN 0 AND 9999 AND (r IS NULL OR r IN ('disabled', 'stopped', 'paused', 'allocation_gap')) AND length(c_mktsegment) > 0 AS valid FROM (SELECT *, {sql_pick(REASONS, 'c_custkey')} AS r FROM customer)")
def p13_exposure_checks(spark, sf_dir):
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", hashing.sha256(F.col("c_name")).alias("user_id_hash"), ((n % 11 - 1) * 1001).alias("bucket"), pick(REASONS, n).alias("fallback_reason"), F.col("c_mktsegment").alias("experiment"), F.lit("v").alias("variant"))
    return rows.select("c_custkey", experiments.valid_exposure().alias("valid"))


PATHS = ["/v1/recommend", "/v1/items/i_1/similar", "/v1/events", "/healthz", "/other", "/v1/recommend/x", "/v1/recommendations", "/v1/item/i_1", "/v1/churn/u1", "/v1/churn", "/V1/events", "/livez", "/livez/x", "/docs", "/redoc", "/openapi.json", "/readyz", "/metrics", "", None, "/v1/similar/i_1", "v1/events"]


@query("p14_path_class", f"""SELECT event_id, CASE WHEN p IN ('/livez', '/healthz', '/readyz', '/metrics', '/docs', '/redoc', '/openapi.json') THEN NULL WHEN starts_with(p, '/v1/recommend') OR starts_with(p, '/v1/items/') THEN 'recommend'
  WHEN starts_with(p, '/v1/events') THEN 'events' WHEN starts_with(p, '/v1/churn/') THEN 'churn' END AS class FROM (SELECT event_id, {sql_pick(PATHS, 'event_id')} AS p FROM events)""")
def p14_path_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.path_class(pick(PATHS, F.col("event_id"))).alias("class"))


HEADERS = ["10.0.0.7", "junk, 10.0.0.8, 9.9.9.9", "not an address", "2001:db8::1, 1.1.1.1", "a,b,c", "", None, "1.2.3.4.5, 8.8.8.8", "::ffff:1, ", "abcd:" * 10 + "1, 3.3.3.3", "300.1.2.3, 4.4.4.4", "  5.5.5.5  , 6.6.6.6"]


def ip_sql(value: str) -> str:
    return rf"coalesce(length({value}) <= 45 AND (regexp_matches({value}, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') OR regexp_matches({value}, '^[0-9A-Fa-f:]+$') AND contains({value}, ':')), false)"


@query("p15_client_ip", f"""SELECT event_id, CASE WHEN {ip_sql('hop')} THEN hop WHEN {ip_sql('peer')} THEN peer ELSE 'unknown' END AS ip FROM (
  SELECT event_id, peer, trim(parts[len(parts) - 1]) AS hop FROM (SELECT event_id, string_split({sql_pick(HEADERS, 'event_id')}, ',') AS parts, CASE WHEN event_id % 5 = 0 THEN 'unix:' WHEN event_id % 5 = 1 THEN '-' ELSE '1.2.3.4' END AS peer FROM events))""")
def p15_client_ip(spark, sf_dir):
    e = F.col("event_id")
    peer = F.when(e % 5 == 0, "unix:").when(e % 5 == 1, "-").otherwise("1.2.3.4")
    return table(spark, sf_dir, "events").select("event_id", text.client_ip(pick(HEADERS, e), peer, 2).alias("ip"))


NAMES = ["OperationalError", "TimeoutError", "ValueError", "ConnectionRefusedError", "InterfaceError", "PoolTimeout", "RedisConnectionError", "BusyLoadingError", None]
MESSAGES = ["Statement TIMEOUT after 1 s", "connection refused", "Password authentication failed", "server closed the connection", "author not found", "?", None]


@query("p16_p17_errors", f"""SELECT event_id, CASE WHEN contains(n, 'timeout') OR contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'refused') THEN 'connection_refused' WHEN contains(m, 'auth') OR contains(m, 'password') THEN 'auth_failed'
  WHEN contains(n, 'connection') OR contains(n, 'operational') THEN 'connection_refused' ELSE 'unknown' END AS kind,
  coalesce(name IN ('ConnectionError', 'ConnectionRefusedError', 'ConnectionResetError', 'ConnectionAbortedError', 'BrokenPipeError', 'TimeoutError', 'TimeoutExpired', 'OperationalError', 'InterfaceError', 'BusyLoadingError', 'ConnectionPoolExhausted'), false) AS counts
  FROM (SELECT *, lower(name) AS n, lower(message) AS m FROM (SELECT event_id, {sql_pick(NAMES, 'event_id')} AS name, {sql_pick(MESSAGES, 'event_id // 9')} AS message FROM events))""")
def p16_errors(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", pick(NAMES, e).alias("name"), pick(MESSAGES, F.floor(e / 9)).alias("message"))
    return rows.select("event_id", sets.error_kind(F.col("name"), F.col("message")).alias("kind"), sets.counts_as_failure(F.col("name")).alias("counts"))


# Sets


@query("u1_u3_u7_sets", fx.with_("golden", then="""SELECT query_id, len(s) AS seeds, len(r) AS relevant, len(list_intersect(s, r)) AS shared, len(list_distinct(list_concat(s, r))) AS either, array_to_string(list_sort(list_distinct(list_concat(s, list_reverse(list_sort(s))))), ',') AS key
FROM (SELECT query_id, list(item_id) FILTER (role = 'seed' OR item_id LIKE '%2') AS s, list(item_id) FILTER (role = 'relevant') AS r FROM golden GROUP BY 1)"""))
def u_sets(spark, sf_dir):
    """Seeds that take in some relevant items."""
    seed = (F.col("role") == "seed") | F.col("item_id").endswith("2")
    g = fx.golden(spark, sf_dir).groupBy("query_id").agg(F.collect_list(F.when(seed, F.col("item_id"))).alias("s"), F.collect_list(F.when(F.col("role") == "relevant", F.col("item_id"))).alias("r"))
    n = lambda c: F.size(c).cast("long")
    return g.select("query_id", n("s").alias("seeds"), n("r").alias("relevant"), n(F.array_intersect("s", "r")).alias("shared"), n(F.array_union("s", "r")).alias("either"), F.array_join(sets.seed_key(F.concat("s", F.sort_array("s", asc=False))), ",").alias("key"))


KNOWN = ("allocation", "name", "salt", "status")


@query("u2_fields", """SELECT c_custkey, array_to_string(list_sort(list_filter(['allocation', 'name', 'salt', 'status'], lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['allocation', 'name', 'salt', 'status'], x))), ',') AS extra
FROM (SELECT c_custkey, list_filter(['name', 'salt', 'status', 'allocation', 'colour', lower(c_mktsegment)], lambda x: (c_custkey + length(x)) % 3 > 0) AS f FROM customer)""")
def u2_fields(spark, sf_dir):
    names = F.array(*map(F.lit, ("name", "salt", "status", "allocation", "colour")), F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.filter(names, lambda x: (F.col("c_custkey") + F.length(x)) % 3 > 0).alias("f"))
    missing, extra = sets.missing_and_extra(F.col("f"), KNOWN)
    return rows.select("c_custkey", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query("a22_most_seeds", fx.with_("golden", then="SELECT max(n) AS most FROM (SELECT count(*) AS n FROM golden WHERE role = 'seed' OR item_id LIKE '%2' GROUP BY query_id)"))
def a22_most_seeds(spark, sf_dir):
    rows = fx.golden(spark, sf_dir).filter("role = 'seed' OR item_id LIKE '%2'").groupBy("query_id").agg(F.collect_list("item_id").alias("seeds"))
    return rows.agg(F.max(F.size("seeds")).cast("long").alias("most"))


@query("a7_a8_provider_status", """SELECT arm, round(coalesce(avg(CASE WHEN missing THEN 1.0 WHEN NOT missing THEN 0.0 END), 0), 6) AS missing_rate, CASE WHEN count(missing) = 0 THEN 'error' WHEN bool_and(missing) THEN 'degraded' ELSE 'ok' END AS status
FROM (SELECT label % 3 AS arm, CASE label % 3 WHEN 0 THEN label % 2 = 0 WHEN 1 THEN true END AS missing FROM (SELECT DISTINCT label FROM embeddings)) GROUP BY 1""")
def a7_a8_status(spark, sf_dir):
    """One arm with a provider that fails at times, one with a provider that always does, one without queries."""
    arm = F.col("label") % 3
    rows = table(spark, sf_dir, "embeddings").select("label").distinct().select(arm.alias("arm"), F.when(arm == 0, F.col("label") % 2 == 0).when(arm == 1, F.lit(True)).alias("missing"))
    return sets.arm_status(rows, "arm", "missing").withColumn("missing_rate", F.round("missing_rate", 6))


@query("a18_readiness", """SELECT day, CASE WHEN count(*) FILTER (required AND NOT ok) > 0 THEN 'not_ready' WHEN count(*) FILTER (NOT required AND NOT ok) > 0 THEN 'degraded' ELSE 'ready' END AS status, CASE WHEN count(*) FILTER (required AND NOT ok) > 0 THEN 503 ELSE 200 END AS http_code FROM (
  SELECT date_trunc('day', ts)::DATE AS day, event_type <> 'error' AS required, value > 1 OR event_type <> 'error' AND (user_id % 17 <> day(ts) OR value > 0.2) AS ok FROM events) GROUP BY 1""")
def a18_readiness(spark, sf_dir):
    """Checks by day: errors stand for the optional ones."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("event_type") != "error").alias("required"), ((F.col("value") > 1) | ((F.col("event_type") != "error") & ((F.col("user_id") % 17 != F.dayofmonth("ts")) | (F.col("value") > 0.2)))).alias("ok"))
    return sets.readiness(rows, "day")


SOURCES = "SELECT event_id, nullif(event_id % 5 = 0, event_id % 3 = 0) AS hit, event_id % 7 < 4 AS ann, event_id % 11 < 6 AS tier3, event_id % 13 < 5 AS tier4 FROM events"


@query("x10_source_label", f"SELECT event_id, CASE WHEN hit THEN 'cache' WHEN ann THEN 'ann' WHEN tier3 THEN 'fallback_ann' WHEN tier4 THEN 'fallback_cached' ELSE 'none' END AS source FROM ({SOURCES})")
def x10_source_label(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", sets.source_label(F.nullif(e % 5 == 0, e % 3 == 0), e % 7 < 4, e % 11 < 6, e % 13 < 5).alias("source"))


# Scalar functions


SPACES = ["", " ", "\t", "\n ", " ", " 　", "\x1c\x1f", "\x85", "​", "\r\n\t"]


def _sql_spaces(number: str) -> str:
    return "([" + ", ".join("''" if not s else " || ".join(f"chr({ord(c)})" for c in s) for s in SPACES) + f"])[CAST({number} % {len(SPACES)} AS INTEGER) + 1]"


PADDED = f"padded AS (SELECT item_id, {_sql_spaces('doc_id')} || title || {_sql_spaces('doc_id // 10')} AS title, {_sql_spaces('doc_id // 3')} || description || {_sql_spaces('doc_id')} AS description FROM catalog)"
ENDS = rf"'^{fx.PYTHON_SPACE}+|{fx.PYTHON_SPACE}+$'"


def _padded(spark, sf_dir):
    """The catalog with white space of all kinds around its texts, and some that is none."""
    n = F.col("doc_id")
    pad = lambda c, before, after: F.concat(pick(SPACES, before), c, pick(SPACES, after))
    return fx.catalog(spark, sf_dir).select("item_id", pad("title", n, F.floor(n / 10)).alias("title"), pad("description", F.floor(n / 3), n).alias("description"))


@query("f2_f3_item_text", fx.with_("catalog", then="").rstrip() + f", {PADDED} SELECT item_id, {fx.item_text_sql()} AS item_text FROM padded")
def f3_item_text(spark, sf_dir):
    """Collapsed, joined and cut item texts, without the Unicode normalisation that SQL lacks."""
    return _padded(spark, sf_dir).select("item_id", text.item_text(F.col("title"), F.col("description"), normalise=False).alias("item_text"))


@query("f30_query_text", fx.with_("catalog", then="").rstrip() + f", {PADDED} SELECT item_id, regexp_replace(title, {ENDS}, '', 'g') || ' | ' || regexp_replace(description, {ENDS}, '', 'g') AS query_text FROM padded")
def f30_query_text(spark, sf_dir):
    return _padded(spark, sf_dir).select("item_id", text.query_text(F.col("title"), F.col("description")).alias("query_text"))


TITLE_JSON = """'"' || replace(replace(p_name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""


@query("f7_f8_index_version", f"""SELECT p_partkey, 'idx-' || substr(sha256('{{"dim":' || p_size || ',"metric":"cosine","model":' || {TITLE_JSON} || ',"parent":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || '}}'), 1, 12) AS index_version FROM part""")
def f8_index_version(spark, sf_dir):
    """Identities of parts: keys in order, nulls kept."""
    fields = {"parent": F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), "model": F.col("p_name"), "metric": F.lit("cosine"), "dim": F.col("p_size")}
    return table(spark, sf_dir, "part").select("p_partkey", hashing.index_version(hashing.canonical_json_column(fields), 12).alias("index_version"))


def hmac_sql(key: bytes, message: str) -> str:
    """The keyed hash of a text, by its definition."""
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in padded).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("f13_user_hashes", f"SELECT user_id, {hmac_sql(KEY, 'CAST(user_id AS VARCHAR)')} AS user_id_hash FROM (SELECT DISTINCT user_id FROM events)")
def f13_user_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", hashing.hmac_sha256(KEY, F.col("user_id").cast("string")).alias("user_id_hash"))


@query("f14_blake2b")
def f14_blake2b(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.blake2b_128(F.col("p_name")).alias("digest"))


@query("f18_recency_decay", f"SELECT event_id, round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{fx.NOW}') - epoch_us(ts)) / 86400e6) / (1 + event_id % 90)), 6) AS decay FROM events")
def f18_recency_decay(spark, sf_dir):
    age = vectors.age_days(fx.now(), F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.round(vectors.recency_decay(age, 1 + F.col("event_id") % 90), 6).alias("decay"))


@query("f20_f21_clamped_distance", fx.with_("item", then="""SELECT item_id, round(greatest(0, least(1, 1 - (1 - d))), 6) AS similarity FROM (SELECT a.item_id, list_inner_product(a.vector, list_transform(b.vector, lambda x: x * 1.5 * CASE WHEN a.vec_id % 2 = 0 THEN 1 ELSE -1 END)) AS d FROM item a JOIN item b ON b.vec_id = a.vec_id - a.vec_id % 3)"""))
def f20_clamped(spark, sf_dir):
    """Similarities beyond both ends."""
    a = fx.items(spark, sf_dir).select("item_id", "vector", "vec_id")
    b = a.select(F.col("vec_id").alias("other"), F.col("vector").alias("w"))
    sign = F.when(F.col("vec_id") % 2 == 0, 1.5).otherwise(-1.5)
    distance = 1 - vectors.dot(F.col("vector"), F.transform("w", lambda x: x.cast("double") * sign))
    return a.join(b, F.col("other") == F.col("vec_id") - F.col("vec_id") % 3).select("item_id", F.round(vectors.clamp(1 - distance), 6).alias("similarity"))


@query("f22_iso_timestamps", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN e WHEN 1 THEN e - 7200 WHEN 2 THEN e + 19800 END AS epoch, CASE WHEN event_id % 6 < 3 THEN epoch(TIMESTAMP '{fx.NOW}') - CASE event_id % 6 WHEN 0 THEN e WHEN 1 THEN e - 7200 WHEN 2 THEN e + 19800 END > 24 * 3600 END AS old
FROM (SELECT event_id, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS e FROM events)""")
def f22_iso(spark, sf_dir):
    """Times with offsets, without one, without a time, and with an impossible month."""
    e = F.col("event_id") % 6
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(e == 0, F.concat(local, F.lit("Z"))).when(e == 1, F.concat(local, F.lit("+02:00"))).when(e == 2, F.concat(local, F.lit("-05:30"))).when(e == 3, local).when(e == 4, "soon").otherwise("2024-13-01T00:00:00Z")
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(text.iso_timestamp(value)).alias("epoch"), text.too_old(value, fx.now(), 24.0).alias("old"))


@query("f23_jittered_ttl", "SELECT event_id, greatest(1, CAST(floor((event_id % 400) * (0.9 + 0.2 * ((event_id % 1000) / 1000))) AS INTEGER)) AS ttl FROM events")
def f23_jittered_ttl(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.jittered_ttl(F.col("event_id") % 400, (F.col("event_id") % 1000) / 1000).alias("ttl"))


VERSIONS = ["0.8.1", "1.12-rc", "x", "", None, "10.3", "7", "1.2.3.4", "v2.1", "2.x"]


@query("f24_version_pair", f"SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(v, '^(\\d+)\\.(\\d+)', 1) AS INTEGER), 0) AS major, coalesce(TRY_CAST(regexp_extract(v, '^(\\d+)\\.(\\d+)', 2) AS INTEGER), 0) AS minor FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {sql_pick(VERSIONS, 'p_partkey // 2')} ELSE p_size || '.' || p_partkey || '-beta' END AS v FROM part)")
def f24_version_pair(spark, sf_dir):
    n = F.col("p_partkey")
    version = F.when(n % 2 == 0, pick(VERSIONS, F.floor(n / 2))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("."), n.cast("string"), F.lit("-beta")))
    return table(spark, sf_dir, "part").select("p_partkey", text.version_pair(version).alias("v")).select("p_partkey", "v.major", "v.minor")


@query("f25_vector_literal", fx.with_("item", then="SELECT item_id, len(vector) AS n, len(vector) AS same, list_contains([0, 1, 2], vec_id % 5) AS whole FROM item"))
def f25_vector_literal(spark, sf_dir):
    """Written and read again, component by component; a spoilt literal has a component that is no number."""
    rows = fx.items(spark, sf_dir).select("item_id", "vec_id", "vector", text.vector_literal(F.col("vector")).alias("literal"))
    back = text.parse_vector(F.col("literal"))
    same = F.size(F.filter(F.zip_with(back, "vector", lambda a, b: a.cast("float") == b), lambda x: x))
    spoilt = text.parse_vector(F.when(F.col("vec_id") % 5 == 3, F.replace("literal", F.lit(","), F.lit(",,"))).when(F.col("vec_id") % 5 == 4, F.replace("literal", F.lit("["), F.lit("[x"))).otherwise(F.col("literal")))
    return rows.select("item_id", F.size(back).cast("long").alias("n"), same.cast("long").alias("same"), F.forall(spoilt, lambda x: x.isNotNull()).alias("whole"))


CREDENTIALS = [" key-1 ", "\tkey-1\n", "key-2", "", "   ", " ", None, "k" * 5000]


@query("f28_credential_buckets", f"""SELECT c_custkey, CASE WHEN length(t) > 0 THEN substr({hmac_sql(KEY, 't')}, 1, 32) END AS bucket FROM (SELECT c_custkey, substr(regexp_replace(CASE c_custkey % 8 WHEN 0 THEN ' key-1 ' WHEN 1 THEN chr(9) || 'key-1' || chr(10) WHEN 2 THEN 'key-2' WHEN 3 THEN '' WHEN 4 THEN '   ' WHEN 5 THEN chr(160) WHEN 7 THEN repeat('k', 5000) END, {ENDS}, '', 'g'), 1, 4096) AS t FROM customer)""")
def f28_credential_buckets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.credential_bucket(KEY, pick(CREDENTIALS, F.col("c_custkey"))).alias("bucket"))


@query("f27_cache_keys")
def f27_cache_keys(spark, sf_dir):
    fields = hashing.canonical_json_column({"k": F.lit(10), "seeds": F.col("p_name"), "brand": F.col("p_brand")})
    return table(spark, sf_dir, "part").select("p_partkey", hashing.cache_key("recommend", fields, F.col("p_type")).alias("key"))


@query("f29_bucket_limits", "SELECT c_custkey, round(greatest(1.0, c_custkey % 700 / 60.0 * 10), 6)::DOUBLE AS capacity, round(c_custkey % 700 / 60.0, 6)::DOUBLE AS rate FROM customer")
def f29_bucket_limits(spark, sf_dir):
    capacity, rate = state.bucket_limits(F.col("c_custkey") % 700)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(capacity, 6).alias("capacity"), F.round(rate, 6).alias("rate"))


@query("f32_request_ids", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'made' ELSE substr(repeat(CAST(event_id AS VARCHAR), 40), 1, 64) END AS request_id, CASE WHEN event_id % 4 < 2 THEN 16 ELSE least(64, 40 * length(CAST(event_id AS VARCHAR))) END AS n FROM events")
def f32_request_ids(spark, sf_dir):
    """Given ids are cut; a missing or empty one is made of 16 hex digits, different for each request."""
    e = F.col("event_id")
    given = F.when(e % 4 == 0, F.lit(None).cast("string")).when(e % 4 == 1, "").otherwise(F.repeat(e.cast("string"), 40))
    rows = table(spark, sf_dir, "events").select("event_id", text.bounded_request_id(given).alias("id"))
    made = (e % 4 < 2) & F.col("id").rlike("^[0-9a-f]{16}$")
    return rows.select("event_id", F.when(made, "made").otherwise(F.col("id")).alias("request_id"), F.length("id").cast("int").alias("n"))


FILE_NAMES = ["v1.jsonl", "v12.jsonl", "v.jsonl", "1.jsonl", "v1.json", "xv1.jsonl", "v1.jsonl.bak", "V1.jsonl", "v01.jsonl", ""]


@query("s4_file_versions", f"SELECT p_partkey, CASE WHEN regexp_matches(f, '^v\\d+\\.jsonl$') THEN regexp_extract(f, '^(v\\d+)', 1) END AS version FROM (SELECT p_partkey, {sql_pick(FILE_NAMES, 'p_partkey')} AS f FROM part)")
def s4_file_versions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", files.version_of(pick(FILE_NAMES, F.col("p_partkey"))).alias("version"))


@query("s20_sidecars", """SELECT 'f' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'no sidecar' WHEN 1 THEN 'another hash' END AS problem FROM part WHERE p_partkey % 4 < 2""")
def s20_sidecars(spark, sf_dir):
    """Hashes against sidecar files that are absent, differ, are in upper case or name the file too."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), hashing.sha256(F.col("p_name")).alias("sha256"))
    n = F.col("p_partkey") % 4
    value = F.when(n == 1, hashing.sha256(F.col("sha256"))).when(n == 2, F.concat(F.lit(" "), F.upper("sha256"), F.lit("\n"))).otherwise(F.concat("sha256", F.lit("  "), "path"))
    return files.sidecar_problems(part, part.filter(n > 0).select(F.concat("path", F.lit(".sha256")).alias("path"), value.alias("value")))


@query("s22_exposition", "SELECT 'events_total{event_type=\"' || event_type || '\",note=\"a' || chr(92) || chr(92) || 'b' || chr(92) || '\"c\"} ' || count(*) AS line FROM events GROUP BY event_type")
def s22_exposition(spark, sf_dir):
    """Lines of a counter with a label that needs escapes."""
    counts = events.outcome_counts(table(spark, sf_dir, "events"), "event_type").withColumn("note", F.lit('a\\b"c'))
    return files.exposition(counts, "events_total", "n", ["event_type", "note"])
