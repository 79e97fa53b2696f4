"""Retrieval, re-ranking, baselines and evaluation over the golden queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaline.functions import hashing, vectors
from tessaline.operators import baselines, evaluation, rerank, search
from tessaline.plans import fixtures as fx
from tessaline.plans.registry import query

VECTOR = ("item", "golden", "qvec", "scored")
CUT = "SELECT query_id, item_id, greatest(0, least(1, score)) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {}) WHERE rank <= {}"
NO_SEEDS = "(SELECT s.* FROM scored s ANTI JOIN (SELECT query_id, item_id FROM golden WHERE role = 'seed') g ON s.query_id = g.query_id AND s.item_id = g.item_id)"
CONFIG = rerank.RerankConfig()


def _vectors(spark, sf_dir):
    return search.query_vectors(fx.seeds(spark, sf_dir), fx.items(spark, sf_dir))


@query("v6_exact_knn", fx.with_(*VECTOR, then=CUT.format(NO_SEEDS, fx.K)))
def v6_exact_knn(spark, sf_dir):
    """Flagship: top-k of every golden query without its seeds."""
    return search.search(_vectors(spark, sf_dir), fx.items(spark, sf_dir), fx.K, exclude=fx.seeds(spark, sf_dir))


@query("v6_filtered_knn", fx.with_(*VECTOR, then=CUT.format("(SELECT s.* FROM scored s JOIN item USING (item_id) WHERE language = 'fr')", fx.K)))
def v6_filtered_knn(spark, sf_dir):
    return search.search(_vectors(spark, sf_dir), fx.items(spark, sf_dir), fx.K, {"language": " fr ", "brand": ""})


@query("v5_query_vectors", fx.with_("item", "golden", "qvec", then="SELECT query_id, list_transform(qv, lambda x: round(x, 6)) AS vector FROM qvec"))
def v5_query_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).select("query_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("t4_overfetch_truncate", fx.with_(*VECTOR, then=CUT.format(NO_SEEDS, 5)))
def t4_overfetch(spark, sf_dir):
    """Fetch k + seeds, drop seeds, keep k."""
    found = search.search(_vectors(spark, sf_dir), fx.items(spark, sf_dir), 5 + 3)
    return search.drop_seeds(found, fx.seeds(spark, sf_dir), 5)


@query("v9_similar_items", fx.with_("item", then="""
SELECT query_id, item_id, greatest(0, least(1, score)) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.item_id AS query_id, i.item_id, round(list_inner_product(i.vector, q.vector) / sqrt(list_inner_product(q.vector, q.vector)), 6) AS score, row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_inner_product(i.vector, q.vector) / sqrt(list_inner_product(q.vector, q.vector)), 6) DESC, i.item_id) AS rank
  FROM item i JOIN item q ON i.item_id <> q.item_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""))
def v9_similar_items(spark, sf_dir):
    """Ten nearest items of every twentieth item."""
    items = fx.items(spark, sf_dir)
    asked = items.filter("vec_id % 20 = 0").select(F.col("item_id").alias("query_id"), vectors.normalise(F.col("vector")).alias("vector"))
    return search.search(asked, items, 10, exclude=asked.select("query_id", F.col("query_id").alias("item_id")))


@query("v18_run_cosine", fx.with_("item", then="SELECT count(*) AS n, round(min(c), 6) AS lowest, round(avg(c), 6) AS mean FROM (SELECT list_inner_product(a.vector, b.v) / sqrt(list_inner_product(a.vector, a.vector) * list_inner_product(b.v, b.v)) AS c FROM item a JOIN (SELECT item_id, list_transform(vector, lambda x: x + 0.001) AS v FROM item) b USING (item_id))"))
def v18_run_cosine(spark, sf_dir):
    """Cosine of each item between two runs."""
    a = fx.items(spark, sf_dir).select("item_id", "vector")
    b = a.select("item_id", F.transform("vector", lambda x: x.cast("double") + 0.001).alias("v"))
    c = vectors.dot(F.col("vector"), F.col("v")) / F.sqrt(vectors.dot(F.col("vector"), F.col("vector")) * vectors.dot(F.col("v"), F.col("v")))
    return a.join(b, "item_id").select(c.alias("c")).agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("lowest"), F.round(F.avg("c"), 6).alias("mean"))


def _candidates(spark, sf_dir, k=fx.K * CONFIG.multiplier):
    items = fx.items(spark, sf_dir)
    found = search.search(_vectors(spark, sf_dir), items, k)
    ages = items.select("item_id", vectors.age_days(fx.now(), F.col("created_at")).alias("age_days"))
    return rerank.candidates(found, fx.popularity(spark, sf_dir), ages)


CANDIDATES = f"""candidate AS (
  SELECT c.query_id, c.item_id, c.score, coalesce(popularity, 0) AS popularity,
         coalesce(greatest(0, (epoch_us(TIMESTAMP '{fx.NOW}') - epoch_us(created_at)) / 86400e6), 0) AS age_days
  FROM ({CUT.format("scored", 40)}) c LEFT JOIN popularity USING (item_id) LEFT JOIN item USING (item_id)),
normed AS (
  SELECT *, CASE WHEN max(score) OVER q = min(score) OVER q THEN 0.5 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q + 1e-8) END AS sim,
         CASE WHEN count(*) OVER q = 1 THEN 0.5 ELSE 1 - ((rank() OVER (PARTITION BY query_id ORDER BY popularity DESC) - 1) + (count(*) OVER (PARTITION BY query_id, popularity) - 1) / 2) / (count(*) OVER q - 1) END AS pop,
         pow(0.5, age_days / 90) AS rec
  FROM candidate WINDOW q AS (PARTITION BY query_id)),
blended AS (SELECT *, round(0.7 * sim + 0.2 * pop + 0.1 * rec, 6) AS blend FROM normed)"""


def _with_candidates(then: str) -> str:
    return fx.with_(*VECTOR, "popularity", then="").rstrip() + ",\n" + CANDIDATES + "\n" + then


@query("v13_candidates", _with_candidates("SELECT query_id, item_id, score, popularity, round(age_days, 6) AS age_days FROM candidate"))
def v13_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query_id", "item_id", "score", "popularity", F.round("age_days", 6).alias("age_days"))


@query("w1_w2_f18_signals", _with_candidates("SELECT query_id, item_id, round(sim, 6) AS sim, round(pop, 6) AS pop, round(rec, 6) AS rec FROM normed"))
def w1_w2_f18_signals(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return rows.select("query_id", "item_id", F.round(vectors.minmax_norm(F.col("score"), "query_id"), 6).alias("sim"), F.round(vectors.rank_norm(F.col("popularity"), "query_id"), 6).alias("pop"), F.round(vectors.recency_decay(F.col("age_days"), 90.0), 6).alias("rec"))


@query("v10_blend", _with_candidates("SELECT query_id, item_id, blend, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, item_id) AS rank FROM blended) WHERE rank <= 10"))
def v10_blend(spark, sf_dir):
    rows = rerank.blend(_candidates(spark, sf_dir), CONFIG).select("query_id", "item_id", F.col("blend").alias("score"))
    return search.top_k(rows, fx.K).withColumnRenamed("score", "blend")


@query("v10_blend_missing_signal", _with_candidates("SELECT query_id, item_id, round(0.7 * sim + 0.2 * 0.5 + 0.1 * rec, 6) AS blend FROM normed"))
def v10_blend_missing(spark, sf_dir):
    """Popularity unavailable: neutral for all."""
    return rerank.blend(_candidates(spark, sf_dir), CONFIG, missing=("popularity",)).select("query_id", "item_id", "blend")


@query("v14_rerank_response", _with_candidates("""SELECT query_id, item_id, blend AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, item_id) AS rank FROM blended b ANTI JOIN (SELECT query_id, item_id FROM golden WHERE role = 'seed') g ON b.query_id = g.query_id AND b.item_id = g.item_id) WHERE rank <= 10"""))
def v14_rerank_response(spark, sf_dir):
    rows = rerank.blend(_candidates(spark, sf_dir), CONFIG).select("query_id", "item_id", F.col("blend").alias("score"))
    return search.drop_seeds(search.top_k(rows, fx.K + 3), fx.seeds(spark, sf_dir), fx.K)


QUERY_IDS = "q AS (SELECT DISTINCT 'q' || label AS query_id FROM embeddings)"
RANDOM = f"""random AS (SELECT query_id, item_id, CAST(10 - (rank - 1) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || chr(0) || item_id), item_id) AS rank FROM q, item) WHERE rank <= 10)"""
POPULAR = """popular AS (SELECT query_id, item_id, score, rank FROM q, (
  SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
    SELECT item_id, CAST(CAST('0x' || substr(sha256(item_id), 1, 8) AS BIGINT) % 1000 AS DOUBLE) AS score FROM item)) WHERE rank <= 10)"""


def _asked(spark, sf_dir):
    return fx.seeds(spark, sf_dir).select("query_id").distinct()


@query("x11_random_baseline", fx.with_("item", then="").rstrip() + f", {QUERY_IDS}, {RANDOM} SELECT * FROM random")
def x11_random_baseline(spark, sf_dir):
    return baselines.random_baseline(_asked(spark, sf_dir), fx.items(spark, sf_dir), fx.K)


@query("x12_popularity_baseline", fx.with_("item", then="").rstrip() + f", {QUERY_IDS}, {POPULAR} SELECT * FROM popular")
def x12_popularity_baseline(spark, sf_dir):
    return baselines.popularity_baseline(_asked(spark, sf_dir), fx.items(spark, sf_dir), fx.K)


@query("t6_popularity_top_k", fx.with_("item", "popularity", then="SELECT item_id, coalesce(popularity, 0) AS score, CAST(row_number() OVER (ORDER BY coalesce(popularity, 0) DESC, item_id) AS INTEGER) AS rank FROM item LEFT JOIN popularity USING (item_id) QUALIFY rank <= 10"))
def t6_popularity_top_k(spark, sf_dir):
    one = spark.createDataFrame([("all",)], "query_id string")
    return baselines.popularity_baseline(one, fx.items(spark, sf_dir), fx.K, fx.popularity(spark, sf_dir)).drop("query_id")


@query("a6_fidelity", fx.with_(*VECTOR, then=f"""
SELECT q.query_id, coalesce(shared, 0) / 10 AS fidelity FROM (SELECT DISTINCT query_id FROM golden) q LEFT JOIN (
  SELECT query_id, count(*) AS shared FROM ({CUT.format("scored", 10)}) JOIN ({CUT.format("(SELECT s.* FROM scored s JOIN item USING (item_id) WHERE vec_id % 4 <> 0)", 10)}) b USING (query_id, item_id) GROUP BY 1) USING (query_id)"""))
def a6_fidelity(spark, sf_dir):
    """Top-k shared by an exact search and one over three quarters of the items."""
    items = fx.items(spark, sf_dir)
    exact = search.search(_vectors(spark, sf_dir), items, fx.K)
    partial = search.search(_vectors(spark, sf_dir), items.filter("vec_id % 4 <> 0"), fx.K)
    return evaluation.fidelity(partial, exact, _asked(spark, sf_dir), fx.K)


SNAPSHOT = "snapshot AS (SELECT item_id, category, brand, language, CAST(row_number() OVER (ORDER BY md5(item_id)) AS INTEGER) AS rank FROM item QUALIFY rank <= 100)"


@query("x6_refresh_snapshot", fx.with_("item", then="").rstrip() + f", {SNAPSHOT} SELECT * FROM snapshot")
def x6_refresh_snapshot(spark, sf_dir):
    return baselines.refresh_snapshot(fx.items(spark, sf_dir), 100)


@query("x7_read_snapshot", fx.with_("item", then="").rstrip() + f", {SNAPSHOT} SELECT item_id, rank, round(1 - rank / ((SELECT max(rank) FROM snapshot) + 1), 6) AS score FROM snapshot WHERE language = 'en' ORDER BY rank LIMIT 10")
def x7_read_snapshot(spark, sf_dir):
    return baselines.read_snapshot(x6_refresh_snapshot(spark, sf_dir), 10, {"language": "en", "brand": None}).withColumn("score", F.round("score", 6))


@query("x9_fallback_chain", fx.with_("item", then="").rstrip() + f""", {SNAPSHOT}
SELECT request, item_id, rank, CASE WHEN request = 'en' THEN 1 ELSE 2 END AS tier FROM (SELECT unnest(['en', 'xx']) AS request), (SELECT * FROM snapshot WHERE rank <= 20) WHERE request = 'xx' OR language = 'en'""")
def x9_fallback_chain(spark, sf_dir):
    """Requests by language: the matching snapshot rows, else the unfiltered ones."""
    snapshot = x6_refresh_snapshot(spark, sf_dir).filter("rank <= 20").select("item_id", "rank", "language")
    asked = F.broadcast(spark.createDataFrame([("en",), ("xx",)], "request string"))
    first = snapshot.join(asked, F.col("request") == F.col("language")).select("request", "item_id", "rank")
    return baselines.first_tier([first, snapshot.crossJoin(asked).select("request", "item_id", "rank")], "request")


@query("f10_synthetic_popularity", fx.with_("item", then="SELECT item_id, CAST(CAST('0x' || substr(sha256(item_id), 1, 8) AS BIGINT) % 1000 AS DOUBLE) AS popularity FROM item"))
def f10_synthetic_popularity(spark, sf_dir):
    return fx.items(spark, sf_dir).select("item_id", hashing.synthetic_popularity(F.col("item_id")).alias("popularity"))


