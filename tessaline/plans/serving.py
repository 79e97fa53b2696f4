"""Approximate search, diversification, the composed pipeline, evaluation of all systems, and the gate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessaline.functions import encoder, text, vectors
from tessaline.operators import backends, cache, evaluation, lifecycle, merge, providers, rerank, search, serving
from tessaline.operators.percentiles import exact_percentiles
from tessaline.plans import fixtures as fx
from tessaline.plans import retrieval as rt
from tessaline.plans.approximate import ALL, twentieth
from tessaline.plans.registry import query
from tessaline.session import cut, shared_folder, table

CONFIG = rt.CONFIG
MMR = replace(CONFIG, mmr=True)


@query("t12_v17_all_pairs_top_k", fx.with_("item", then="").rstrip() + f", {ALL} {rt.CUT.format('scored', 10)}")
def t12_all_pairs(spark, sf_dir):
    """Ten nearest of all items for every twentieth, itself included."""
    return search.search(twentieth(spark, sf_dir), fx.items(spark, sf_dir), 10)


# Encoding


def encoded_sql(dim: int) -> str:
    """Signed feature hashing of texts (id, t), by its definition."""
    return f"""words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(t), '{fx.PYTHON_SPACE}+'), lambda w: w <> '')) AS w FROM texts),
hashed AS (SELECT id, CAST('0x' || substr(sha256(w), 1, 16) AS UBIGINT) AS h FROM words),
sums AS (SELECT id, CAST(h % {dim} AS INTEGER) AS d, sum(CASE WHEN h >= 9223372036854775808 THEN 1.0 ELSE -1.0 END) AS x FROM hashed GROUP BY ALL),
sizes AS (SELECT id, sqrt(sum(x * x)) AS n FROM sums GROUP BY 1),
encoded AS (SELECT t.id, r.d, CASE WHEN coalesce(n, 0) < 1e-12 THEN CASE WHEN r.d = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(CAST(coalesce(x, 0) / n AS FLOAT) AS DOUBLE) END AS x
  FROM texts t CROSS JOIN (SELECT unnest(range({dim})) AS d) r LEFT JOIN sums s ON s.id = t.id AND s.d = r.d LEFT JOIN sizes z ON z.id = t.id)"""


@query("v16_encode_catalog", fx.with_("catalog", then="").rstrip() + f", texts AS (SELECT item_id AS id, {fx.item_text_sql('nfc_normalize(title)', 'nfc_normalize(description)')} AS t FROM catalog), {encoded_sql(32)} SELECT id AS item_id, list(round(x, 5) ORDER BY d) AS embedding FROM encoded GROUP BY 1")
def v16_encode(spark, sf_dir):
    """Texts as vectors. The data hold no characters that only the compatibility normalisation changes, so the SQL uses the canonical one."""
    model = encoder.HashingEncoder(32)
    rows = fx.catalog(spark, sf_dir).select("item_id", encoder.encode(text.item_text(F.col("title"), F.col("description")), model).alias("embedding"))
    return rows.select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("v16_token_vectors")
def v16_token_vectors(spark, sf_dir):
    """The catalog by the tokenising encoder, over a public vocabulary."""
    import public_tokenizers

    model = encoder.TokenEncoder(public_tokenizers.path("word_bpe_49k.json"), 32)
    return fx.catalog(spark, sf_dir).select("item_id", encoder.encode(text.item_text(F.col("title"), F.col("description")), model).alias("embedding"))


DIM, RUN_BUCKETS = 8, 8


def _runs(spark, sf_dir):
    """(plan, previous run, all items encoded) of the two catalogs, as a run stores them."""
    model = encoder.HashingEncoder(DIM)
    own = lambda rows: rows.select("item_id", text.content_hash(F.col("title"), F.col("description"), normalise=False).alias("content_hash"), encoder.encode(text.item_text(F.col("title"), F.col("description")), model).alias("embedding"))
    new, old = own(fx.catalog(spark, sf_dir)), own(fx.previous_catalog(spark, sf_dir))
    plan = new.select("item_id", "content_hash").join(lifecycle.change_plan(new.select("item_id", "content_hash"), old.select("item_id", "content_hash")).filter("change <> 'deleted'"), "item_id")
    return plan, old, new


def _merged(spark, plan, previous, encoded):
    folder = shared_folder(spark, "merge")
    sides = [merge.write_sorted(rows, f"{folder}/{name}", RUN_BUCKETS) for rows, name in ((plan, "plan"), (previous, "previous"), (encoded, "encoded"))]
    found = merge.merge_sorted(*sides, DIM)
    return found.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)))


RUN_SQL = fx.with_("catalog", "previous", then="").rstrip() + f""", texts AS (SELECT item_id AS id, {fx.item_text_sql('nfc_normalize(title)', 'nfc_normalize(description)')} AS t FROM catalog), {encoded_sql(DIM)},
vectors AS (SELECT id AS item_id, list(round(x, 5) ORDER BY d) AS embedding FROM encoded GROUP BY 1),
hashes AS (SELECT item_id, substr(sha256({fx.item_text_sql()}), 1, 16) AS content_hash FROM catalog),
before AS (SELECT item_id, substr(sha256({fx.item_text_sql()}), 1, 16) AS content_hash FROM previous)
SELECT h.item_id, h.content_hash, embedding, {{reused}} AS reused FROM hashes h JOIN vectors USING (item_id) LEFT JOIN before b ON b.item_id = h.item_id"""


@query("j10_d4_sorted_merge", RUN_SQL.replace("{reused}", "coalesce(h.content_hash = b.content_hash, false)"))
def j10_sorted_merge(spark, sf_dir):
    """Unchanged vectors of the previous run and newly encoded ones, as sorted streams."""
    plan, old, new = _runs(spark, sf_dir)
    return _merged(spark, plan, old, new.join(plan.filter("change <> 'unchanged'").select("item_id"), "item_id", "left_semi"))


@query("d1_full_run", RUN_SQL.replace("{reused}", "false"))
def d1_full_run(spark, sf_dir):
    """A run that encodes everything, whatever an earlier one holds."""
    plan, old, new = _runs(spark, sf_dir)
    return _merged(spark, plan.withColumn("change", F.lit("new")), old.limit(0), new)


def _text_seeds(spark, sf_dir):
    """(query_id, item_id): every document, three for each query, some of them twice, one unknown."""
    some = fx.catalog(spark, sf_dir).select(F.concat(F.lit("t"), F.floor(F.col("doc_id") / 3).cast("string")).alias("query_id"), "item_id")
    return some.unionByName(some.limit(5)).unionByName(spark.createDataFrame([("t0", "unknown"), ("none", "unknown")], "query_id string, item_id string"))


@query("v4_encoded_queries", fx.with_("catalog", then="").rstrip() + f""", texts AS (SELECT item_id AS id, regexp_replace(title, '^{fx.PYTHON_SPACE}+|{fx.PYTHON_SPACE}+$', '', 'g') || ' | ' || regexp_replace(description, '^{fx.PYTHON_SPACE}+|{fx.PYTHON_SPACE}+$', '', 'g') AS t FROM catalog), {encoded_sql(16)},
means AS (SELECT 't' || (CAST(substr(id, 3) AS BIGINT) // 3) AS query_id, d, avg(x) AS x FROM encoded GROUP BY ALL)
SELECT query_id, list(round(x / n, 4) ORDER BY d) AS vector FROM means JOIN (SELECT query_id, sqrt(sum(x * x)) AS n FROM means GROUP BY 1) USING (query_id) GROUP BY 1""")
def v4_encoded_queries(spark, sf_dir):
    """Query vectors from the seeds' texts, encoded again."""
    rows = serving.encoded_query_vectors(_text_seeds(spark, sf_dir), fx.catalog(spark, sf_dir), encoder.HashingEncoder(16))
    return rows.select("query_id", F.transform("vector", lambda x: vectors.signed_round(x, 4)).alias("vector"))


# Diversification


@query("v11_mmr_status", "WITH q AS (SELECT DISTINCT 'q' || label AS query_id, label FROM embeddings) SELECT query_id, CASE WHEN label % 4 = 0 THEN 'no_candidates' WHEN label % 4 = 1 THEN 'k_below_min' WHEN label % 4 = 2 THEN 'no_vectors' ELSE 'applied' END AS status, 'disabled' AS switched_off FROM q")
def v11_mmr_status(spark, sf_dir):
    found = search.search(rt._vectors(spark, sf_dir), fx.items(spark, sf_dir), 20).join(fx.items(spark, sf_dir).select("item_id", "vector"), "item_id")
    label = F.substring("query_id", 2, 9).cast("int")
    found = found.filter(label % 4 != 0).withColumn("vector", F.when((label % 4 != 2) | (F.col("rank") != 7), F.col("vector")))
    asked = fx.seeds(spark, sf_dir).select("query_id").distinct().withColumn("k", F.when(label % 4 == 1, 9).otherwise(10))
    off = rerank.mmr_status(found, asked, CONFIG).withColumnRenamed("status", "switched_off")
    return rerank.mmr_status(found, asked, MMR).join(off, "query_id")


#: Pools, cosines within them, and the choice one by one. A window holds all of the 40 candidates.
CHOICE = """pool AS (SELECT query_id, item_id, blend, vector FROM blended JOIN item USING (item_id)),
alike AS (SELECT a.query_id, a.item_id AS a, b.item_id AS b, list_inner_product(a.vector, b.vector) / (sqrt(list_inner_product(a.vector, a.vector)) * sqrt(list_inner_product(b.vector, b.vector))) AS cosine FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.item_id <> b.item_id),
choice AS (
  SELECT query_id, 0 AS step, CAST([] AS VARCHAR[]) AS picked FROM (SELECT DISTINCT query_id FROM pool)
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, min_by(item_id, (-v, item_id))) FROM (
    SELECT c.query_id, c.step, c.picked, p.item_id, round(0.7 * p.blend - 0.3 * coalesce(max(s.cosine), 0), 9) AS v
    FROM choice c JOIN pool p ON p.query_id = c.query_id LEFT JOIN alike s ON s.query_id = c.query_id AND s.a = p.item_id AND list_contains(c.picked, s.b)
    WHERE c.step < {steps} AND NOT list_contains(c.picked, p.item_id) GROUP BY c.query_id, c.step, c.picked, p.item_id, p.blend)
  GROUP BY query_id, step, picked),
diverse AS (SELECT query_id, unnest(picked) AS item_id, generate_subscripts(picked, 1) AS place FROM choice WHERE step = {steps})"""


def _with_choice(steps: int, then: str) -> str:
    return rt._with_candidates("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + CHOICE.format(steps=steps) + "\n" + then


@query("v12_mmr", _with_choice(10, "SELECT query_id, item_id, blend, CAST(place AS INTEGER) AS rank FROM diverse JOIN blended USING (query_id, item_id)"))
def v12_mmr(spark, sf_dir):
    rows = rerank.blend(rt._candidates(spark, sf_dir), MMR).join(fx.items(spark, sf_dir).select("item_id", "vector"), "item_id")
    return rerank.mmr(rows, fx.K, MMR)


# The composed pipeline


def _requests(spark, sf_dir):
    """The golden queries' seeds, a request without seeds and one with unknown seeds."""
    rows = fx.seeds(spark, sf_dir).groupBy("query_id").agg(F.collect_list("item_id").alias("seeds"))
    return rows.unionByName(spark.createDataFrame([("empty", []), ("nothing", None), ("unknown", ["x", "y"])], "query_id string, seeds array<string>"))


def _popularity(spark, sf_dir):
    return providers.TableSignal(fx.popularity(spark, sf_dir).withColumnRenamed("popularity", "value"))


def _retrieve(spark, sf_dir, config, popularity=None, filters=None, backend=backends.exact):
    """The requests, and what is retrieved for them."""
    items, requests = fx.items(spark, sf_dir), _requests(spark, sf_dir)
    asked = search.query_vectors(requests.select("query_id", F.explode("seeds").alias("item_id")), items)
    recency = providers.CreatedAtRecency(items, fx.now())
    return requests, serving.retrieve(requests, asked, items, fx.K, config, popularity or _popularity(spark, sf_dir), recency, filters, backend)


def _recommend(spark, sf_dir, config, popularity=None, filters=None):
    requests, retrieval = _retrieve(spark, sf_dir, config, popularity, filters)
    return serving.respond(retrieval, requests, fx.K, config), retrieval


BEST = """SELECT query_id, item_id, blend AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, item_id) AS rank FROM (SELECT * REPLACE ({blend} AS blend) FROM blended) b ANTI JOIN (SELECT query_id, item_id FROM golden WHERE role = 'seed') g ON b.query_id = g.query_id AND b.item_id = g.item_id) WHERE rank <= 10"""


@query("v15_recommend", rt._with_candidates(BEST.format(order="blend", blend="blend")))
def v15_recommend(spark, sf_dir):
    return _recommend(spark, sf_dir, CONFIG)[0]


@query("v15_recommend_without_popularity", rt._with_candidates(BEST.format(order="blend", blend="round(0.7 * sim + 0.2 * 0.5 + 0.1 * rec, 6)")))
def v15_without_popularity(spark, sf_dir):
    """A provider that fails is neutral for all."""
    return _recommend(spark, sf_dir, CONFIG, providers.Unavailable())[0]


@query("v15_recommend_diverse", _with_choice(13, "SELECT query_id, item_id, blend AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank FROM diverse d JOIN blended USING (query_id, item_id) WHERE NOT EXISTS (FROM golden g WHERE g.role = 'seed' AND g.query_id = d.query_id AND g.item_id = d.item_id) QUALIFY rank <= 10"))
def v15_diverse(spark, sf_dir):
    return _recommend(spark, sf_dir, MMR)[0]


@query("v15_outcomes", "SELECT DISTINCT 'q' || label AS query_id, 'ok' AS outcome FROM embeddings UNION ALL VALUES ('empty', 'empty_seeds'), ('nothing', 'empty_seeds'), ('unknown', 'all_seeds_missing')")
def v15_outcomes(spark, sf_dir):
    """A filter that leaves nothing is a valid empty answer."""
    rows, retrieval = _recommend(spark, sf_dir, CONFIG, filters={"brand": "no such brand"})
    return retrieval.outcomes.join(rows.select("query_id").distinct(), "query_id", "left_anti")


@query("f26_cache_rows", rt._with_candidates("SELECT query_id, count(*) AS n, min_by(item_id, (-score, item_id)) AS first, round(sum(age_days), 4) AS ages, count(*) FILTER (item_id LIKE '%7') AS spoilt FROM candidate GROUP BY 1"))
def f26_cache_rows(spark, sf_dir):
    """Candidate lists written as JSON and read back; of a second writing some entries are spoilt, which makes the value unreadable."""
    rows = rt._candidates(spark, sf_dir)
    kept = cache.pack_candidates(rows)
    back = cache.unpack_candidates(kept)
    read = back.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("item_id", F.struct(-F.col("similarity"), "item_id")).alias("first"), F.round(F.sum("age_days"), 4).alias("ages"))
    spoilt = cache.unpack_errors(rows.select("query_id", "item_id", F.when(F.col("item_id").endswith("7"), '[["x",1.0,2.0]]').otherwise(F.to_json(F.array(F.array("item_id", F.col("score").cast("string"))))).alias("value")))
    return read.join(spoilt.groupBy("query_id").agg(F.count(F.when(F.col("unreadable"), 1)).alias("spoilt")), "query_id")


# Evaluation


ARMS = """found AS (
  SELECT 'exact_knn' AS system, query_id, item_id, rank FROM ({exact})
  UNION ALL SELECT 'random_baseline', query_id, item_id, rank FROM random
  UNION ALL SELECT 'popularity_synthetic', query_id, item_id, rank FROM popular
  UNION ALL SELECT 'exact_knn_blend', query_id, item_id, rank FROM ({blend})
  UNION ALL SELECT 'exact_knn_blend_mmr', query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM diverse d WHERE NOT EXISTS (FROM golden g WHERE g.role = 'seed' AND g.query_id = d.query_id AND g.item_id = d.item_id) QUALIFY rank <= 10)),
wanted AS (SELECT query_id, list(item_id) AS relevant, count(*) AS n FROM golden WHERE role = 'relevant' GROUP BY 1),
metric AS (
  SELECT s.system, w.query_id, coalesce(hits, 0) / least(n, 10) AS recall,
         coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1 / first, 0) AS mrr
  FROM wanted w CROSS JOIN (SELECT DISTINCT system FROM found) s LEFT JOIN (
    SELECT system, f.query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain, min(rank) AS first
    FROM found f JOIN wanted w ON f.query_id = w.query_id AND list_contains(w.relevant, f.item_id) GROUP BY ALL) h ON h.system = s.system AND h.query_id = w.query_id),
report AS (
  SELECT system, metric, value FROM (UNPIVOT (SELECT system, avg(recall) AS recall_at_10, avg(ndcg) AS ndcg_at_10, avg(mrr) AS mrr FROM metric GROUP BY 1) ON recall_at_10, ndcg_at_10, mrr INTO NAME metric VALUE value)
  UNION ALL VALUES ('exact_knn', 'ann_recall_vs_exact', 1.0::DOUBLE)
  UNION ALL SELECT s, m, v FROM (VALUES ('exact_knn_blend'), ('exact_knn_blend_mmr')) a(s), (VALUES ('ann_recall_vs_exact_pre_rerank', 1.0::DOUBLE), ('provider_missing_rate_popularity', 0), ('provider_missing_rate_recency', 0)) b(m, v))""".format(exact=rt.CUT.format(rt.NO_SEEDS, fx.K), blend=BEST.format(order="blend", blend="blend"))


def _evaluated(then: str) -> str:
    return _with_choice(13, "").rstrip() + f",\n{rt.QUERY_IDS},\n{rt.RANDOM},\n{rt.POPULAR},\n{ARMS}\n{then}"


def _ranked(spark, sf_dir, backend=backends.exact, name="exact_knn"):
    """(system, query_id, item_id, rank) of a backend and of its two re-ranked arms; what the arms' retrieval shares with exact search; and missing rates.

    One retrieval serves all three: without its seeds, its best are the plain answer. It and the ranked rows, a few for each query, are
    written for their several uses.
    """
    named = lambda df, system: df.select(F.lit(system).alias("system"), "query_id", "item_id", "rank")
    seeds, asked = fx.seeds(spark, sf_dir), rt._asked(spark, sf_dir)
    requests, retrieval = _retrieve(spark, sf_dir, CONFIG, backend=backend)
    retrieval = replace(retrieval, candidates=cut(retrieval.candidates))
    plain = cut(search.drop_seeds(retrieval.candidates.select("query_id", "item_id", "score"), seeds, fx.K))
    exact = plain if backend is backends.exact else cut(rt.v6_exact_knn(spark, sf_dir))
    shared = cut(evaluation.mean_fidelity(plain, exact, asked, fx.K, name, "ann_recall_vs_exact"))
    rows, extra = named(plain, name), shared
    for arm, config in ((f"{name}_blend", CONFIG), (f"{name}_blend_mmr", MMR)):
        rows = rows.unionByName(named(serving.respond(retrieval, requests, fx.K, config), arm))
        rates = [(arm, f"provider_missing_rate_{signal}", float(signal in retrieval.missing)) for signal in ("popularity", "recency")]
        own = shared.select(F.lit(arm).alias("system"), F.lit("ann_recall_vs_exact_pre_rerank").alias("metric"), "value")
        extra = extra.unionByName(own).unionByName(spark.createDataFrame(rates, "system string, metric string, value double"))
    return rows, extra


def _systems(spark, sf_dir):
    named = lambda df, system: df.select(F.lit(system).alias("system"), "query_id", "item_id", "rank")
    rows, extra = _ranked(spark, sf_dir)
    baselines = named(rt.x11_random_baseline(spark, sf_dir), "random_baseline").unionByName(named(rt.x12_popularity_baseline(spark, sf_dir), "popularity_synthetic"))
    return cut(rows.unionByName(baselines)), extra


def _report(spark, sf_dir):
    rows, extra = _systems(spark, sf_dir)
    return evaluation.report(evaluation.query_metrics(rows, fx.relevant(spark, sf_dir), fx.K), fx.K).unionByName(extra)


@query("x13_x15_query_metrics", _evaluated("SELECT system, query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM metric"))
def x13_query_metrics(spark, sf_dir):
    """Recall, NDCG and MRR of each system and golden query (A3 to A5); the baselines keep their seeds."""
    rows = evaluation.query_metrics(_systems(spark, sf_dir)[0], fx.relevant(spark, sf_dir), fx.K)
    return rows.select("system", "query_id", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")])


@query("x14_x16_report", _evaluated("SELECT system, metric, round(value, 6) AS value FROM report"))
def x16_report(spark, sf_dir):
    """All systems over exact search, re-ranked arms with the fidelity of their retrieval and the signals they missed."""
    return _report(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("x16_ann_report")
def x16_ann_report(spark, sf_dir):
    """The same systems over the layered graph."""
    rows, extra = _ranked(spark, sf_dir, backends.backend("hnsw", fx.items(spark, sf_dir)), "hnsw")
    return evaluation.report(evaluation.query_metrics(cut(rows), fx.relevant(spark, sf_dir), fx.K), fx.K).unionByName(extra)


LIMITS = [
    ("exact_knn", "recall_at_10", "absolute_floor", 2.0), ("exact_knn", "recall_at_10", "per_system", 3.0), ("exact_knn", "mrr", "per_system", -1.0), ("exact_knn", "absent", "per_system", 9.0), ("exact_knn", "ndcg_at_10", "per_system", None),
    ("random_baseline", "mrr", "absolute_floor", 0.5), ("popularity_synthetic", "mrr", "informational_floor", -1.0), ("exact_knn_blend", "mrr", "per_system", 5.0), ("exact_knn_blend", "ann_recall_vs_exact_pre_rerank", "informational_floor", 0.5),
    ("exact_knn_blend_mmr", "provider_missing_rate_recency", "informational_floor", 0.0), ("exact_knn_blend_mmr", "mrr", "informational_floor", -0.5),
]
INFORMATIONAL = ["exact_knn_blend", "exact_knn_blend_mmr"]
LIMITS_SQL = "limits(system, metric, kind, threshold) AS (VALUES " + ", ".join(f"('{s}', '{m}', '{k}', {'NULL' if t is None else t}::DOUBLE)" for s, m, k, t in LIMITS) + ")"
FAILING = f"""failing AS (SELECT system, metric, kind, value, threshold FROM report JOIN limits USING (system, metric) WHERE CASE WHEN system IN ('{"', '".join(INFORMATIONAL)}') THEN kind = 'informational_floor' AND value > threshold ELSE kind <> 'informational_floor' AND value < threshold END)"""


def _limits(spark):
    return spark.createDataFrame(LIMITS, "system string, metric string, kind string, threshold double")


@query("x17_gate", _evaluated(f", {LIMITS_SQL}, {FAILING} SELECT false AS passed, CAST(NULL AS VARCHAR) AS reason, system, metric, kind, round(value, 6) AS value, threshold FROM failing").replace("\n, limits", ",\nlimits"))
def x17_gate(spark, sf_dir):
    """The metrics that fail; a floor and the system's own threshold each for itself."""
    header = spark.createDataFrame([("v1", "abc", None)], "golden_set_version string, commit string, created_at string")
    rows = evaluation.gate(_report(spark, sf_dir), _limits(spark), header, evaluation.GateRules("v1", "abc"), INFORMATIONAL)
    return rows.withColumn("value", F.round("value", 6))


#: Seven reports of the events: another version, another commit, no time, a time without an offset, an old one, a system that is absent, and one that is sound.
REPORTS = ("sound", "version", "commit", "no_time", "bad_time", "old", "absent")
GATE_NOW = "2024-01-31T00:00:00Z"
GATE_SQL = f"""WITH e AS (SELECT user_id % 7 AS g, event_type AS system, value, ts FROM events),
value AS (SELECT g, system, 'mean' AS metric, avg(value) AS value FROM e GROUP BY ALL),
limits AS (SELECT system, 'mean' AS metric, 'per_system' AS kind, avg(value) AS threshold FROM e GROUP BY ALL UNION ALL SELECT system, 'mean', 'absolute_floor', 0.5 * avg(value) FROM e GROUP BY ALL),
header AS (SELECT g, CASE WHEN g = 5 THEN min(ts) ELSE max(ts) END AS created, list(DISTINCT system) AS systems FROM e GROUP BY g),
stage AS (SELECT g, CASE WHEN g = 1 THEN 'golden_set_version' WHEN g = 2 THEN 'commit' WHEN g = 3 THEN 'created_at is missing' WHEN g = 4 THEN 'created_at is no time'
  WHEN epoch(TIMESTAMP '2024-01-31') - epoch_us(created) / 1e6 > 24 * 3600 THEN 'age'
  WHEN g = 6 OR NOT list_contains(systems, 'purchase') THEN 'missing: ' || array_to_string(list_sort(list_filter(CASE WHEN g = 6 THEN ['purchase', 'rental'] ELSE ['purchase'] END, lambda x: NOT list_contains(systems, x))), ', ') END AS reason FROM header),
failing AS (SELECT g, system, metric, kind, round(value, 6) AS value, round(threshold, 6) AS threshold FROM value JOIN limits USING (system, metric) WHERE value < threshold)
SELECT list_extract([{", ".join(f"'{r}'" for r in REPORTS)}], CAST(s.g AS INTEGER) + 1) AS report, s.reason IS NULL AND f.g IS NULL AS passed, s.reason, f.system, f.metric, f.kind, f.value, f.threshold FROM stage s LEFT JOIN failing f ON s.reason IS NULL AND f.g = s.g"""


@query("x17_a17_gate_stages", GATE_SQL)
def x17_gate_stages(spark, sf_dir):
    """Reports that fail before their metrics count, and one whose metrics do."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("g"), F.col("event_type").alias("system"), "value", "ts")
    mean = log.groupBy("system").agg(F.avg("value").alias("m"))
    limits = mean.select("system", F.lit("mean").alias("metric"), F.explode(F.array(F.struct(F.lit("per_system").alias("kind"), F.col("m").alias("threshold")), F.struct(F.lit("absolute_floor").alias("kind"), (0.5 * F.col("m")).alias("threshold")))).alias("limit")).select("system", "metric", "limit.*")
    out = None
    for g, name in enumerate(REPORTS):
        own = log.filter(F.col("g") == g)
        values = own.groupBy("system").agg(F.lit("mean").alias("metric"), F.avg("value").alias("value"))
        created = F.date_format(F.min("ts") if name == "old" else F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("" if name == "bad_time" else "'Z'"))
        header = own.groupBy("g").agg((F.lit(None).cast("string") if name == "no_time" else created).alias("created_at"))
        header = header.select(F.lit("v0" if name == "version" else "v1").alias("golden_set_version"), F.lit("xyz" if name == "commit" else "abc").alias("commit"), "created_at")
        rules = evaluation.GateRules("v1", "abc", GATE_NOW, 24.0, ("purchase", "rental") if name == "absent" else ("purchase",))
        one = evaluation.gate(values, limits, header, rules).select(F.lit(name).alias("report"), "passed", "reason", "system", "metric", "kind", *[F.round(c, 6).alias(c) for c in ("value", "threshold")])
        out = one if out is None else out.unionByName(one)
    return out


@query("j15_a17_gate_passes", "SELECT count(*) = 0 AS passed, CASE WHEN count(*) > 0 THEN min(system) END AS first_failing FROM (SELECT event_type AS system, avg(value) AS value, quantile_cont(value, 0.25) AS threshold FROM events GROUP BY 1) WHERE value < threshold")
def j15_gate_passes(spark, sf_dir):
    """A report whose means are held against the lower quartiles of their own systems: a single row that passed, unless a distribution is very skewed."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), "value", "ts")
    values = log.groupBy("system").agg(F.lit("mean").alias("metric"), F.avg("value").alias("value"))
    limits = exact_percentiles(log, "value", [0.25], "system").select("system", F.lit("mean").alias("metric"), F.lit("per_system").alias("kind"), F.col("value").alias("threshold"))
    header = log.agg(F.lit("v1").alias("golden_set_version"), F.lit("abc").alias("commit"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"))
    found = evaluation.gate(values, limits, header, evaluation.GateRules("v1", "abc", None, None, ("purchase", "view")))
    return found.agg(F.bool_and("passed").alias("passed"), F.min("system").alias("first_failing"))


WINDOWED = replace(MMR, mmr_window=6)


@query("u5_rerank_window", _with_choice(6, "SELECT query_id, item_id, blend, CAST(place AS INTEGER) AS rank FROM diverse JOIN blended USING (query_id, item_id) UNION ALL SELECT query_id, item_id, blend, CAST(place AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, item_id) AS place FROM blended) WHERE place BETWEEN 7 AND 10").replace("pool AS (SELECT query_id, item_id, blend, vector FROM blended JOIN item USING (item_id))", "pool AS (SELECT query_id, item_id, blend, vector FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, item_id) AS place FROM blended) JOIN item USING (item_id) WHERE place <= 6)"))
def u5_rerank_window(spark, sf_dir):
    """A window of six within pools of forty: four rows follow it in the order of the blend."""
    rows = rerank.blend(rt._candidates(spark, sf_dir), WINDOWED).join(fx.items(spark, sf_dir).select("item_id", "vector"), "item_id")
    return rerank.mmr(rows, fx.K, WINDOWED)


@query("ext_cache_warm", fx.with_("item", "popularity", then=f"""
, popular AS (SELECT item_id, vector FROM item LEFT JOIN popularity USING (item_id) ORDER BY coalesce(popularity, 0) DESC, item_id LIMIT 5),
scored AS (SELECT p.item_id AS query_id, i.item_id, round(list_inner_product(i.vector, p.vector) / sqrt(list_inner_product(p.vector, p.vector)), 6) AS score FROM item i JOIN popular p ON i.item_id <> p.item_id)
{rt.CUT.format('scored', 10)}""").replace("\n\n, popular", ",\npopular"))
def ext_cache_warm(spark, sf_dir):
    """Lists for the items asked for most, to be stored before they are asked for."""
    items = fx.items(spark, sf_dir)
    best = items.join(fx.popularity(spark, sf_dir), "item_id", "left").orderBy(F.desc(F.coalesce("popularity", F.lit(0.0))), "item_id").limit(5)
    asked = best.select(F.col("item_id").alias("query_id"), vectors.normalise(F.col("vector")).alias("vector"))
    return search.search(asked, items, 10, exclude=asked.select("query_id", F.col("query_id").alias("item_id")))


@query("f1_f5_content_hash", fx.with_("catalog", then=f"SELECT item_id, substr(sha256({fx.item_text_sql('nfc_normalize(title)', 'nfc_normalize(description)')}), 1, 16) AS content_hash FROM catalog"))
def f5_content_hash(spark, sf_dir):
    """Content hashes of the fully normalised texts; as for v16, the canonical normalisation is enough for these data."""
    return fx.catalog(spark, sf_dir).select("item_id", text.content_hash(F.col("title"), F.col("description")).alias("content_hash"))

