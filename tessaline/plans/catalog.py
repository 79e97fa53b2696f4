"""Catalog text, incremental plans and the index registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaline.functions import text, vectors
from tessaline.operators import lifecycle
from tessaline.plans import fixtures as fx
from tessaline.plans.registry import query
from tessaline.session import table
from tessaline.sources import files

HASH = f"substr(sha256({fx.item_text_sql()}), 1, 16)"
HASHED = f"""new AS (SELECT item_id, {HASH} AS content_hash FROM catalog),
old AS (SELECT item_id, {HASH} AS content_hash FROM previous),
plan AS (SELECT item_id, CASE WHEN old.content_hash IS NULL THEN 'new' WHEN new.content_hash IS NULL THEN 'deleted' WHEN new.content_hash = old.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM new FULL JOIN old USING (item_id))"""


def _hashed(rows):
    return rows.select("item_id", text.content_hash(F.col("title"), F.col("description"), normalise=False).alias("content_hash"))


def _planned(then):
    return fx.with_("catalog", "previous", then="").rstrip() + ",\n" + HASHED + "\n" + then


def _plan(spark, sf_dir):
    return lifecycle.change_plan(_hashed(fx.catalog(spark, sf_dir)), _hashed(fx.previous_catalog(spark, sf_dir)))


@query("f4_f5_plain_content_hash", fx.with_("catalog", then=f"SELECT item_id, {HASH} AS content_hash FROM catalog"))
def f4_plain_hash(spark, sf_dir):
    return _hashed(fx.catalog(spark, sf_dir))


@query("a13_catalog_snapshot", _planned("SELECT 'sha256:' || substr(sha256(string_agg(item_id || ':' || content_hash, chr(10) ORDER BY item_id)), 1, 16) AS snapshot FROM new"))
def a13_snapshot(spark, sf_dir):
    return lifecycle.snapshot_hash(_hashed(fx.catalog(spark, sf_dir)))


@query("d2_j9_change_plan", _planned("SELECT * FROM plan"))
def d2_change_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("a15_plan_counts", _planned("SELECT change, count(*) AS n FROM plan GROUP BY 1"))
def a15_plan_counts(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query("j11_deleted_ids", _planned("SELECT item_id FROM plan WHERE change = 'deleted'"))
def j11_deleted(spark, sf_dir):
    return fx.previous_catalog(spark, sf_dir).select("item_id").join(fx.catalog(spark, sf_dir).select("item_id"), "item_id", "left_anti")


@query("d4_u4_merged_run", _planned("SELECT item_id, content_hash, CASE change WHEN 'unchanged' THEN 'old' ELSE 'new' END AS run FROM plan JOIN new USING (item_id)"))
def d4_merged_run(spark, sf_dir):
    previous = _hashed(fx.previous_catalog(spark, sf_dir)).withColumn("run", F.lit("old"))
    encoded = _hashed(fx.catalog(spark, sf_dir)).withColumn("run", F.lit("new"))
    return lifecycle.merge_run(_plan(spark, sf_dir), previous, encoded)


@query("d5_upsert", fx.with_("catalog", "previous", then=f"""
SELECT coalesce(n.item_id, o.item_id) AS item_id, CASE WHEN n.item_id IS NOT NULL THEN n.title ELSE o.title END AS title,
       CASE WHEN o.item_id IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{fx.NOW}' END AS created_at,
       CASE WHEN n.item_id IS NOT NULL THEN TIMESTAMP '{fx.NOW}' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM catalog n FULL JOIN previous o ON n.item_id = o.item_id"""))
def d5_upsert(spark, sf_dir):
    then = F.lit("2024-01-01").cast("timestamp")
    old = fx.previous_catalog(spark, sf_dir).select("item_id", "title", then.alias("created_at"), then.alias("updated_at"))
    rows = lifecycle.upsert(old, fx.catalog(spark, sf_dir).select("item_id", "title"), "item_id", ["created_at"], fx.now())
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


SPOILT_RUN = f"""run AS (SELECT item_id, CASE WHEN doc_id % 35 = 3 THEN upper({HASH}) ELSE {HASH} END AS content_hash FROM (SELECT * FROM previous p JOIN (SELECT item_id AS i, doc_id FROM catalog) ON i = item_id) WHERE doc_id % 35 <> 1
  UNION ALL SELECT p.item_id, {HASH} FROM previous p JOIN (SELECT item_id AS i, doc_id FROM catalog) ON i = p.item_id WHERE doc_id % 35 = 2)"""


@query("j10_merge_errors", _planned("SELECT 1").removesuffix("SELECT 1").rstrip() + f""",
{SPOILT_RUN},
have AS (SELECT item_id, count(*) AS n, min(content_hash) AS h FROM run GROUP BY 1),
kept AS (SELECT plan.item_id, n, h, new.content_hash FROM plan JOIN new USING (item_id) LEFT JOIN have USING (item_id) WHERE change = 'unchanged')
SELECT item_id, CASE WHEN n IS NULL THEN 'absent from the previous run' WHEN n > 1 THEN 'repeated in the previous run' ELSE 'another hash in the previous run' END AS reason FROM kept WHERE n IS NULL OR n > 1 OR h <> content_hash
UNION ALL SELECT item_id, 'repeated' FROM kept WHERE n > 1""")
def j10_merge_errors(spark, sf_dir):
    """A previous run that lost, repeated and altered rows: what stops the merge of unchanged items."""
    ids = fx.catalog(spark, sf_dir).select("item_id", "doc_id")
    run = _hashed(fx.previous_catalog(spark, sf_dir)).join(ids, "item_id")
    n = F.col("doc_id") % 35
    rows = run.filter(n != 1).withColumn("content_hash", F.when(n == 3, F.upper("content_hash")).otherwise(F.col("content_hash"))).unionByName(run.filter(n == 2))
    rows = rows.select("item_id", "content_hash", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    return lifecycle.merge_errors(_plan(spark, sf_dir), rows, _hashed(fx.catalog(spark, sf_dir)), 2)


NO_OP = "SELECT kind, count(*) FILTER (change IN ('new', 'changed')) AS to_encode, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'deleted') AS deleted, kind = 'same' AS no_changes FROM (SELECT 'same' AS kind, 'unchanged' AS change FROM new UNION ALL SELECT 'deletion', CASE WHEN item_id LIKE '%7' THEN 'deleted' ELSE 'unchanged' END FROM new UNION ALL SELECT 'edited', change FROM plan) GROUP BY 1"


@query("d2_no_changes", _planned(NO_OP))
def d2_no_changes(spark, sf_dir):
    """The same catalog again, one that only lost items, and an edited one."""
    new, old = _hashed(fx.catalog(spark, sf_dir)), _hashed(fx.previous_catalog(spark, sf_dir))
    less = new.filter(~F.col("item_id").endswith("7"))
    out = None
    for kind, now, before in (("same", new, new), ("deletion", less, new), ("edited", new, old)):
        snapshot = lifecycle.snapshot_hash(before).first().snapshot
        one = lifecycle.no_changes(lifecycle.change_plan(now, before), snapshot, lifecycle.snapshot_hash(now)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


#: Indexes by label; the registered rows of one are wrong, and the label tells the rest.
REGISTRY = f"""registry AS (SELECT 'idx-' || label AS index_version, CASE label WHEN 0 THEN 'active' WHEN 1 THEN 'building' WHEN 2 THEN 'building' WHEN 9 THEN 'failed' ELSE 'retired' END AS status, count(*) + CASE WHEN label = 2 THEN 1 ELSE 0 END AS row_count, count(*) AS stored,
  CASE WHEN label <> 1 THEN TIMESTAMP '2024-01-01' + to_days(CAST(label AS INTEGER)) END AS activated_at, CASE WHEN label BETWEEN 3 AND 7 THEN TIMESTAMP '2024-01-10' + to_days(CAST(label * 3 % 7 AS INTEGER)) END AS retired_at FROM embeddings GROUP BY label)"""
TARGETS = ["idx-0", "idx-1", "idx-2", "idx-4", "idx-9", "idx-x"]
OUTCOMES = f"""asked AS (SELECT unnest({TARGETS}) AS target), outcome AS (SELECT target, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'active' THEN 'already_active' WHEN status NOT IN ('building', 'retired') THEN 'status' WHEN row_count <> stored THEN 'row_count' ELSE 'promoted' END AS outcome FROM asked LEFT JOIN registry ON index_version = target)"""


def _registry(spark, sf_dir):
    label, day = F.col("label"), lambda text, n: F.timestamp_seconds(F.unix_timestamp(F.lit(text).cast("timestamp")) + n * 86400)
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    status = F.when(label == 0, "active").when(label.isin(1, 2), "building").when(label == 9, "failed").otherwise("retired")
    return rows.select(F.concat(F.lit("idx-"), label.cast("string")).alias("index_version"), status.alias("status"), (F.col("n") + (label == 2).cast("long")).alias("row_count"), F.when(label != 1, day("2024-01-01", label)).alias("activated_at"), F.when(label.between(3, 7), day("2024-01-10", label * 3 % 7)).alias("retired_at"))


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("idx-"), F.col("label").cast("string")).alias("index_version")).agg(F.count("*").alias("stored"))


def _plain(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("activated_at", "retired_at")})


@query("d9_promotions", f"WITH {REGISTRY}, {OUTCOMES} SELECT target AS index_version, outcome FROM outcome")
def d9_promotions(spark, sf_dir):
    """What comes of promoting each of several indexes."""
    out = None
    for target in TARGETS:
        one = lifecycle.promotion(_registry(spark, sf_dir), target, _stored(spark, sf_dir))
        out = one if out is None else out.unionByName(one)
    return out


@query("d9_promote", f"""WITH {REGISTRY}, {OUTCOMES} SELECT target, index_version, CASE WHEN outcome = 'promoted' AND index_version = target THEN 'active' WHEN outcome = 'promoted' AND status = 'active' THEN 'retired' ELSE status END AS status, row_count,
  CASE WHEN outcome = 'promoted' AND index_version = target THEN TIMESTAMP '{fx.NOW}' ELSE activated_at END AS activated_at, CASE WHEN outcome = 'promoted' AND index_version = target THEN NULL WHEN outcome = 'promoted' AND status = 'active' THEN TIMESTAMP '{fx.NOW}' ELSE retired_at END AS retired_at FROM registry, outcome""")
def d9_promote(spark, sf_dir):
    """The registry after each of them."""
    out = None
    for target in TARGETS:
        one = lifecycle.promote(_registry(spark, sf_dir), target, _stored(spark, sf_dir), fx.now()).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return _plain(out)


@query("d10_t10_rollback", f"""WITH {REGISTRY}, target AS (SELECT index_version AS t FROM registry WHERE status = 'retired' ORDER BY retired_at DESC NULLS LAST, index_version LIMIT 1)
SELECT index_version, CASE WHEN index_version = t THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status, row_count, CASE WHEN index_version = t THEN TIMESTAMP '{fx.NOW}' ELSE activated_at END AS activated_at, CASE WHEN index_version = t THEN NULL WHEN status = 'active' THEN TIMESTAMP '{fx.NOW}' ELSE retired_at END AS retired_at FROM registry, target""")
def d10_rollback(spark, sf_dir):
    return _plain(lifecycle.rollback(_registry(spark, sf_dir), _stored(spark, sf_dir), fx.now()))


@query("d8_register_build", f"WITH {REGISTRY} SELECT index_version, status, row_count FROM registry WHERE index_version <> 'idx-1' UNION ALL VALUES ('idx-1', 'building', 77), ('idx-new', 'building', 5)")
def d8_register_build(spark, sf_dir):
    """A new build, and one again that a crash had left."""
    rows = lifecycle.register_build(_registry(spark, sf_dir), "idx-1", {}, 77)
    return lifecycle.register_build(rows, "idx-new", {"activated_at": None}, 5).select("index_version", "status", "row_count")


@query("a9_rows_by_version", "SELECT 'idx-' || label AS index_version, count(*) AS stored FROM embeddings GROUP BY label")
def a9_rows(spark, sf_dir):
    return _stored(spark, sf_dir)


@query("s5_s7_run_scan", fx.with_("item", then="SELECT item_id, round(list_sum(list_transform(vector, lambda x: x * x)), 4) AS squared, brand, language FROM item"))
def s7_run_scan(spark, sf_dir):
    """A run's columns beside the items' metadata, where there are any."""
    items = fx.items(spark, sf_dir)
    run = items.select("item_id", F.col("vector").alias("embedding"), F.md5("item_id").alias("content_hash"))
    rows = files.previous_vectors(run, 64).join(items.select("item_id", "brand", "language"), "item_id", "left")
    return rows.select("item_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), "brand", "language")


GOLDEN_ROWS = """own AS (SELECT query_id, CAST(substr(query_id, 2) AS INTEGER) % 6 AS n, list(item_id ORDER BY item_id) FILTER (role = 'seed') AS s, list(item_id ORDER BY item_id) FILTER (role = 'relevant') AS r FROM golden GROUP BY 1),
spoilt AS (SELECT CASE WHEN n = 5 THEN 'same' ELSE query_id END AS query_id, CASE n WHEN 1 THEN [] WHEN 2 THEN list_append(s, s[1]) WHEN 4 THEN list_append(s, 'zz') ELSE s END AS s, CASE WHEN n = 3 THEN list_append(r, s[1]) ELSE r END AS r FROM own UNION ALL SELECT 'same', ['i_0001'], ['i_0002'])"""


@query("s3_j12_golden_errors", fx.with_("item", "golden", then="").rstrip() + f""", {GOLDEN_ROWS}
SELECT query_id, CASE WHEN len(s) < 1 THEN 'no seeds' WHEN len(list_distinct(s)) < len(s) OR len(list_distinct(r)) < len(r) THEN 'repeated item' ELSE 'seed is relevant' END AS error FROM spoilt WHERE len(s) < 1 OR len(list_distinct(s)) < len(s) OR len(list_distinct(r)) < len(r) OR list_has_any(s, r)
UNION ALL SELECT query_id, 'repeated query_id' FROM spoilt GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT DISTINCT query_id, 'unknown item' FROM (SELECT query_id, unnest(list_concat(s, r)) AS i FROM spoilt) WHERE i NOT IN (SELECT item_id FROM item)""")
def s3_golden_errors(spark, sf_dir):
    """Golden queries with one fault each, by label."""
    g = fx.golden(spark, sf_dir)
    pick = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("item_id"))))
    rows = g.groupBy("query_id").agg(pick("seed").alias("s"), pick("relevant").alias("r")).withColumn("n", F.substring("query_id", 2, 9).cast("int") % 6)
    n, s, r = F.col("n"), F.col("s"), F.col("r")
    seeds = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array_append(s, s[0])).when(n == 4, F.array_append(s, F.lit("zz"))).otherwise(s)
    spoilt = rows.select(F.when(n == 5, "same").otherwise(F.col("query_id")).alias("query_id"), seeds.alias("seed_item_ids"), F.when(n == 3, F.array_append(r, s[0])).otherwise(r).alias("relevant_item_ids"))
    same = spark.createDataFrame([("same", ["i_0001"], ["i_0002"])], "query_id string, seed_item_ids array<string>, relevant_item_ids array<string>")
    return files.golden_errors(spoilt.unionByName(same), fx.items(spark, sf_dir))


@query("d13_cascade_delete", fx.with_("item", then="SELECT item_id FROM item WHERE vec_id % 3 <> 0"))
def d13_cascade(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    return lifecycle.cascade_delete(items.select("item_id"), items.filter("vec_id % 3 <> 0"))


def _lines(spark, sf_dir):
    """The catalog as JSON lines, some of them spoilt by doc_id."""
    rows = fx.catalog(spark, sf_dir)
    whole = F.to_json(F.struct("item_id", "title", "description", "category", "brand"))
    value = F.when(F.col("doc_id") % 13 == 1, F.lit("[1, 2]")).when(F.col("doc_id") % 13 == 2, F.to_json(F.struct("item_id", "title"))).when(F.col("doc_id") % 13 == 3, F.lit("{broken")).when(F.col("doc_id") % 13 == 4, F.lit("  ")).when(F.col("doc_id") % 13 == 5, F.to_json(F.struct(F.lit("").alias("item_id"), "title", "description", "category", "brand"))).otherwise(whole)
    rows = rows.select(F.col("doc_id").alias("line"), value.alias("value"))
    return rows.unionByName(rows.filter("line % 13 = 0").withColumn("line", F.col("line") + 1_000_000_000))


@query("s1_catalog_errors", fx.with_("catalog", then="""
SELECT doc_id AS line, CASE doc_id % 13 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'missing field' WHEN 3 THEN 'not a JSON object' ELSE 'empty item_id' END AS error FROM catalog WHERE doc_id % 13 IN (1, 2, 3, 5)
UNION ALL SELECT doc_id + 1000000000, 'repeated item_id' FROM catalog WHERE doc_id % 13 = 0"""))
def s1_catalog_errors(spark, sf_dir):
    return files.catalog_errors(_lines(spark, sf_dir))


@query("s1_s2_catalog_scan", fx.with_("catalog", then="SELECT item_id, title, description, category, brand FROM catalog WHERE doc_id % 13 NOT IN (1, 2, 3, 4, 5)"))
def s1_catalog_scan(spark, sf_dir):
    return files.parse_catalog(_lines(spark, sf_dir))


@query("s12_snapshot_json", fx.with_("item", then="SELECT item_id, CAST(row_number() OVER (ORDER BY md5(item_id)) AS INTEGER) AS rank, category, brand, language FROM item QUALIFY rank <= 100"))
def s12_snapshot_json(spark, sf_dir):
    """A snapshot written as one JSON document and read back."""
    from tessaline.operators.baselines import refresh_snapshot

    return files.parse_snapshot(files.snapshot_json(refresh_snapshot(fx.items(spark, sf_dir), 100)))


@query("a21_duplicates", "SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def a21_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n"))
    return rows.filter("n > 1")
