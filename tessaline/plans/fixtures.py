"""The roles of the engine's inputs, derived from the test tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.session import table

NOW = "2024-01-30 00:00:00"
K = 10


def now():
    return F.lit(NOW).cast("timestamp")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, vector, category, brand, language, created_at, label."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    rows = table(spark, sf_dir, "embeddings").join(part, F.col("vec_id") == F.col("p_partkey"), "left")
    created = F.timestamp_seconds(F.unix_timestamp(now()) - F.pmod("vec_id", F.lit(365)) * 86400)
    return rows.select(F.format_string("i_%04d", "vec_id").alias("item_id"), F.col("embedding").alias("vector"), "category", "brand", F.when(F.col("vec_id") % 2 == 0, "en").otherwise("fr").alias("language"), created.alias("created_at"), "label", "vec_id")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, item_id, role: per label the three smallest ids are seeds, the next seven relevant."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = rows.withColumn("nth", nth).filter("nth <= 10")
    return rows.select(F.concat(F.lit("q"), F.col("label").cast("string")).alias("query_id"), F.format_string("i_%04d", "vec_id").alias("item_id"), F.when(F.col("nth") <= 3, "seed").otherwise("relevant").alias("role"))


def seeds(spark, sf_dir):
    return golden(spark, sf_dir).filter("role = 'seed'").select("query_id", "item_id")


def relevant(spark, sf_dir):
    return golden(spark, sf_dir).filter("role = 'relevant'").groupBy("query_id").agg(F.collect_list("item_id").alias("relevant"))


def popularity(spark, sf_dir):
    """Real popularity: order lines of each part."""
    return table(spark, sf_dir, "lineitem").groupBy(F.format_string("i_%04d", "l_partkey").alias("item_id")).agg(F.count("*").cast("double").alias("popularity"))


def event_batch(spark, sf_dir):
    """Events as ingest batches of 20 with one index each; ids of every eleventh are left out."""
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "purchase", "conversion").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.when(F.col("event_id") % 11 != 0, F.format_string("event-%08d", "event_id")).alias("event_id"), F.col("ts").cast("timestamp").alias("event_ts"), kind.alias("event_type"), F.col("user_id").cast("string").alias("user_id"),
        F.format_string("i_%04d", F.get_json_object("props", "$.k").cast("int")).alias("item_id"), F.concat(F.lit("r"), (F.col("event_id") / 20).cast("bigint").cast("string")).alias("request_id"), (F.col("event_id") % 20).cast("int").alias("index"),
        (F.col("event_id") % 7).cast("int").alias("position"), "value",
    )


def catalog(spark, sf_dir):
    """item_id, title (first line), description (the rest), category, brand of documents."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    parts = F.split("text", "\n", 2)
    return rows.select(F.format_string("d_%06d", "doc_id").alias("item_id"), parts[0].alias("title"), F.coalesce(F.get(parts, 1), F.lit("")).alias("description"), F.col("lang").alias("category"), F.col("source").alias("brand"), "doc_id")


def previous_catalog(spark, sf_dir):
    """An earlier catalog: every seventh item is absent, every fifth had another title, and one item in nine has since gone."""
    rows = catalog(spark, sf_dir).filter("doc_id % 7 <> 0").withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    gone = catalog(spark, sf_dir).filter("doc_id % 9 = 0").withColumn("item_id", F.concat(F.lit("x"), "item_id"))
    return rows.unionByName(gone)


EXPERIMENTS = [
    ("ranker", "salt-a", "running", [("control", 50), ("blend", 30), ("mmr", 20)], None),
    ("layout", "salt-b", "paused", [("off", 50), ("on", 50)], None),
    ("gap", "salt-c", "running", [("a", 40), ("b", 20)], None),
    ("old", "salt-d", "stopped", [("x", 100)], "2024-01-01"),
]


def experiments(spark):
    return spark.createDataFrame(EXPERIMENTS, "name string, salt string, status string, allocation array<struct<variant:string,pct:int>>, stopped_at string")


# The same in DuckDB SQL: common table expressions by name.

SQL = {
    "item": f"""item AS (
  SELECT printf('i_%04d', vec_id) AS item_id, CAST(embedding AS DOUBLE[]) AS vector, p_type AS category, p_brand AS brand,
         CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'fr' END AS language, TIMESTAMP '{NOW}' - to_days(CAST(vec_id % 365 AS INTEGER)) AS created_at, label, vec_id
  FROM embeddings LEFT JOIN part ON vec_id = p_partkey)""",
    "golden": """golden AS (
  SELECT 'q' || label AS query_id, printf('i_%04d', vec_id) AS item_id, CASE WHEN nth <= 3 THEN 'seed' ELSE 'relevant' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings) WHERE nth <= 10)""",
    "qvec": """qmean AS (
  SELECT query_id, list(x ORDER BY pos) AS m FROM (
    SELECT query_id, pos, avg(x) AS x FROM (
      SELECT query_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM golden JOIN item USING (item_id) WHERE role = 'seed') GROUP BY ALL) GROUP BY query_id),
qvec AS (SELECT query_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS qv FROM qmean)""",
    "scored": """scored AS (SELECT query_id, item_id, round(list_inner_product(vector, qv), 6) AS score FROM item, qvec)""",
    "popularity": """popularity AS (SELECT printf('i_%04d', l_partkey) AS item_id, CAST(count(*) AS DOUBLE) AS popularity FROM lineitem GROUP BY 1)""",
    "batch": """batch AS (
  SELECT CASE WHEN event_id % 11 <> 0 THEN printf('event-%08d', event_id) END AS event_id, ts AS event_ts,
         CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_type, CAST(user_id AS VARCHAR) AS user_id,
         printf('i_%04d', CAST(json_extract_string(props, '$.k') AS INTEGER)) AS item_id, 'r' || (event_id // 20) AS request_id, CAST(event_id % 20 AS INTEGER) AS "index",
         CAST(event_id % 7 AS INTEGER) AS position, value
  FROM events)""",
    "catalog": """catalog AS (
  SELECT printf('d_%06d', doc_id) AS item_id, CASE WHEN contains(text, chr(10)) THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description, lang AS category, source AS brand, doc_id
  FROM documents WHERE text IS NOT NULL)""",
    "previous": """previous AS (
  SELECT item_id, CASE WHEN doc_id % 5 = 0 THEN 'old ' || title ELSE title END AS title, description FROM catalog WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'x' || item_id, title, description FROM catalog WHERE doc_id % 9 = 0)""",
}


PYTHON_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapsed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '{PYTHON_SPACE}+', ' ', 'g'))"


def item_text_sql(title: str = "title", description: str = "description") -> str:
    t, d = collapsed(title), collapsed(description)
    return f"trim(substr(CASE WHEN length({d}) > 0 THEN {t} || ' | ' || {d} ELSE {t} END, 1, 512))"


def with_(*names: str, then: str) -> str:
    """A query over the named common table expressions."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + then
