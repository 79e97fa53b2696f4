"""Predicates, set operations and remaining operators as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessaline.functions import vectors
from tessaline.operators import baselines, lifecycle, search, sets
from tessaline.plans import fixtures as fx
from tessaline.plans import retrieval as rt
from tessaline.plans.registry import query
from tessaline.session import shared_folder, table
from tessaline.sources import files

CUT, VECTOR = rt.CUT, rt.VECTOR


@query("v7_search_with_vectors", fx.with_(*VECTOR, then=f"SELECT query_id, item_id, round(list_sum(list_transform(vector, lambda x: x * x)), 4) AS squared FROM ({CUT.format('scored', 5)}) JOIN item USING (item_id)"))
def v7_search_with_vectors(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    found = search.search(rt._vectors(spark, sf_dir), items, 5).join(items.select("item_id", "vector"), "item_id")
    return found.select("query_id", "item_id", F.round(vectors.dot(F.col("vector"), F.col("vector")), 4).alias("squared"))


@query("x8_cached_snapshot", fx.with_("item", then="").rstrip() + f", {rt.SNAPSHOT} SELECT item_id, rank, round(1 - rank / ((SELECT max(rank) FROM snapshot) + 1), 6) AS score FROM snapshot WHERE language = 'fr' ORDER BY rank LIMIT 5")
def x8_cached_snapshot(spark, sf_dir):
    """The JSON twin of a snapshot, filtered and cut."""
    cached = files.parse_snapshot(files.snapshot_json(rt.x6_refresh_snapshot(spark, sf_dir)))
    return baselines.read_snapshot(cached, 5, {"language": "fr"}).withColumn("score", F.round("score", 6))


@query("s19_sample_catalog", "SELECT printf('i_%04d', n) AS item_id, 'topic ' || ((n - 1) // 10) AS topic, 'brand ' || ((n - 1) % 10 % (SELECT count(*) FROM region)) AS brand, CASE WHEN (n - 1) % 10 < 3 THEN 'seed' ELSE 'relevant' END AS role FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) // 10 * 10 + 1)) AS n)")
def s19_sample_catalog(spark, sf_dir):
    """As many topics of ten items as there are tens of parts, a brand for each region in turn; a topic's first three items are seeds."""
    parts, regions = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "region").count()
    return sets.sample_catalog(spark, topics=parts // 10, each=10, brands=regions)


@query("ext_drift", fx.with_("item", then="SELECT round(list_inner_product(a.c, b.c) / sqrt(list_inner_product(a.c, a.c) * list_inner_product(b.c, b.c)), 6) AS cosine FROM (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(x) AS m FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM item WHERE vec_id % 2 = 0) GROUP BY 1)) a, (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(x) AS m FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM item WHERE vec_id % 2 = 1) GROUP BY 1)) b"))
def ext_drift(spark, sf_dir):
    """Cosine of the centroids of two halves."""
    means = vectors.mean_vectors(fx.items(spark, sf_dir).select((F.col("vec_id") % 2).alias("half"), "vector"), "half", "vector")
    return sets.centroid_cosine(means, "half").select(F.round("cosine", 6).alias("cosine"))


@query("ext_prune", "SELECT printf('i_%04d', vec_id) AS item_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 ORDER BY max(vec_id) DESC LIMIT 3)")
def ext_prune(spark, sf_dir):
    """Rows of the three newest versions, a label standing for a version."""
    return lifecycle.prune(fx.items(spark, sf_dir).select("item_id", "label", "vec_id"), "label", "vec_id", 3).select("item_id")


# Stored runs and indexes, written to the shared folder and read again


@query("s6_t11_written_run", fx.with_("item", then="SELECT item_id, md5(item_id) AS content_hash, len(vector) AS dim, round(list_sum(vector), 4) AS total, row_number() OVER (ORDER BY item_id) - 1 AS place FROM item"))
def s6_written_run(spark, sf_dir):
    """A run as it is stored: checked, and in the order of ids over all its files."""
    run = fx.items(spark, sf_dir).select("item_id", F.col("vector").alias("embedding"), F.md5("item_id").alias("content_hash"), F.lit("1").alias("preprocessing_version"))
    path = shared_folder(spark, "run")
    files.write_run(run, path, 64)
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored.groupBy("file").agg(F.min("item_id").alias("first"), F.max("item_id").alias("last"), F.count("*").alias("n"))
    ranges = ranges.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each file
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "row")) - 1
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = stored.withColumn("nth", place).join(F.broadcast(ranges), "file")
    return rows.select("item_id", "content_hash", F.size("embedding").cast("long").alias("dim"), F.round(total, 4).alias("total"), (F.col("before") + F.col("nth")).alias("place"))


def _index(spark, sf_dir):
    """An index table of a version for each label, of which one is built twice."""
    path = shared_folder(spark, "index")
    items = fx.items(spark, sf_dir).select("item_id", "label", F.lit(1).alias("build"))
    items.withColumn("index_version", F.concat(F.lit("v"), F.col("label").cast("string"))).drop("label").write.partitionBy("index_version").parquet(path)
    files.write_index(items.filter("label = 3").select("item_id", F.lit(2).alias("build")), path, "v3")
    return path


@query("p6_d8_version_scan", fx.with_("item", then="SELECT 'v' || label AS version, item_id, CASE WHEN label = 3 THEN 2 ELSE 1 END AS build FROM item WHERE label IN (3, 4)"))
def p6_version_scan(spark, sf_dir):
    """Two versions of an index table, each read by its own partition; a later build replaced one of them."""
    path = _index(spark, sf_dir)
    read = lambda v: files.read_index(spark, path, v).select(F.lit(v).alias("version"), "item_id", "build")
    return read("v3").unionByName(read("v4"))


@query("a10_row_count_checks", "SELECT version, count(vec_id) AS n, count(vec_id) > 0 AS ok FROM (SELECT 'v' || x AS version, x FROM (SELECT unnest(range(12)) AS x)) LEFT JOIN embeddings ON label = x GROUP BY 1")
def a10_row_count_checks(spark, sf_dir):
    """Readiness of each expected version by its rows: none is not ready."""
    path = _index(spark, sf_dir)
    expected = spark.range(12).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("version"))
    counts = spark.read.parquet(path).groupBy(F.col("index_version").alias("version")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return expected.join(counts, "version", "left").select("version", n.alias("n"), (n > 0).alias("ok"))
