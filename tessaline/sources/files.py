"""Line-delimited JSON, run directories, pointers and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.session import small
from tessaline.sources.config import read_pointer, write_pointer, write_text

CATALOG = "item_id string, title string, description string, category string, brand string"
GOLDEN = "query_id string, topic string, seed_item_ids array<string>, relevant_item_ids array<string>"
VERSION_NAME = r"^v\d+\.jsonl$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files, line from 1 within each file by its byte order.

    Only the counts of each file's splits are ordered in one place; a line adds its place in its split.
    """
    at = F.monotonically_increasing_id()
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.shiftright(at, 33).alias("split"), at.bitwiseAND((1 << 33) - 1).alias("place"))
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("f"), F.col("split").alias("s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = rows.join(small(splits), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    return joined.select((F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.filter(F.trim("value") != "").select("line", "value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))


def catalog_errors(lines: DataFrame) -> DataFrame:
    """(line, error) of every line that is no valid catalog item. A repeated id is an error on each later line."""
    rows = _parsed(lines, CATALOG)
    fields = [c.split()[0] for c in CATALOG.split(", ")]
    gone = F.lit(False)
    for f in fields:
        gone = gone | F.col(f"r.{f}").isNull()
    nth = F.row_number().over(Window.partitionBy("r.item_id").orderBy("line"))
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{"), "not a JSON object").when(gone, "missing field").when(F.col("r.item_id") == "", "empty item_id").when(F.col("nth") > 1, "repeated item_id")
    return rows.withColumn("nth", nth).select("line", error.alias("error")).filter("error IS NOT NULL")


def parse_catalog(lines: DataFrame) -> DataFrame:
    """Valid catalog items; use catalog_errors to reject a file."""
    good = _parsed(lines, CATALOG).join(catalog_errors(lines).select("line"), "line", "left_anti")
    return good.select("r.item_id", "r.title", "r.description", "r.category", "r.brand")


def golden_errors(golden: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, error): no seeds, repeated ids, seeds that are relevant too, repeated query_id, ids unknown to the catalog."""
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    error = F.when(F.size("seed_item_ids") < 1, "no seeds").when(repeated("seed_item_ids") | repeated("relevant_item_ids"), "repeated item").when(F.arrays_overlap("seed_item_ids", "relevant_item_ids"), "seed is relevant")
    own = golden.select("query_id", error.alias("error")).filter("error IS NOT NULL")
    twice = golden.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("repeated query_id").alias("error"))
    ids = golden.select("query_id", F.explode(F.array_union("seed_item_ids", "relevant_item_ids")).alias("item_id"))
    unknown = ids.join(catalog.select("item_id"), "item_id", "left_anti").select("query_id", F.lit("unknown item").alias("error")).distinct()
    return own.unionByName(twice).unionByName(unknown)


def version_of(file_name) -> F.Column:
    return F.when(file_name.rlike(VERSION_NAME), F.regexp_extract(file_name, r"^(v\d+)", 1))


def write_run(run: DataFrame, path: str, dim: int | None = None) -> None:
    """A run: fixed columns, zstd, sorted by id within ranges of ids. With dim, rows that a run must not hold are an error before anything is written; an empty run is written as such."""
    columns = ["item_id", "embedding", "content_hash", "preprocessing_version"]
    if dim is not None and (bad := invalid_embeddings(run, dim).first()):
        raise ValueError(f"{bad.item_id}: {bad.reason}")
    run.select(*columns).repartitionByRange("item_id").sortWithinPartitions("item_id").write.option("compression", "zstd").parquet(path)


def invalid_embeddings(run: DataFrame, dim: int, tolerance: float = 1e-4) -> DataFrame:
    """(item_id, reason) of rows that a run must not hold."""
    from tessaline.functions.vectors import norm

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    reason = F.when(F.size("embedding") != dim, "dimension").when(~finite, "not finite").when(F.abs(norm(F.col("embedding")) - 1) > tolerance, "norm")
    twice = run.groupBy("item_id").count().filter("count > 1").select("item_id", F.lit("repeated").alias("reason"))
    return run.select("item_id", reason.alias("reason")).filter("reason IS NOT NULL").unionByName(twice)


def snapshot_json(snapshot: DataFrame) -> DataFrame:
    """One row with the JSON document of a popularity snapshot (a bounded top-N)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id", "category", "brand", "language"))), lambda r: F.struct(r["item_id"].alias("item_id"), r["rank"].alias("rank"), r["category"].alias("category"), r["brand"].alias("brand"), r["language"].alias("language")))
    return snapshot.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), items.alias("items"))).alias("value"))


def parse_snapshot(value: DataFrame) -> DataFrame:
    schema = "schema_version int, items array<struct<item_id string, rank int, category string, brand string, language string>>"
    return value.select(F.explode(F.from_json("value", schema)["items"]).alias("i")).select("i.*")


def write_report(values: DataFrame, path: str, **header: str) -> None:
    """The report's document, written beside and renamed."""
    write_text(Path(path), report_json(values, **header) + "\n")


def replace_snapshot(snapshot: DataFrame, folder: str, name: str) -> None:
    """A whole snapshot in place of the last: written under a name of its own, then pointed at, so that readers see one or the other."""
    snapshot.write.parquet(f"{folder}/{name}")
    write_pointer(folder, name)


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    name = read_pointer(folder)
    if name is None:
        raise LookupError(f"{folder} has no snapshot")
    return spark.read.parquet(f"{folder}/{name}")


def report_json(values: DataFrame, **header: str) -> str:
    """The nested JSON report of a long (system, metric, value) table: one row for each system's metric."""
    systems: dict[str, dict] = {}
    for r in values.orderBy("system", "metric").toLocalIterator():
        systems.setdefault(r.system, {"metrics": {}})["metrics"][r.metric] = r.value
    return json.dumps({"schema_version": 1, **header, "systems": systems}, sort_keys=True, indent=2)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def exposition(counters: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Text lines of a metric: name{label="value",...} number."""
    escape = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = [F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels]
    return counters.select(F.concat(F.lit(name), F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))


def render_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a few rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("n/a" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows)])


def previous_vectors(run: DataFrame, dim: int) -> DataFrame:
    """(item_id, embedding, content_hash) of a run, only these columns of it; a vector of another length is an error, a run without rows is empty."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    vector = F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("ragged vector of "), "item_id")))
    return run.select("item_id", vector.alias("embedding"), "content_hash")


def read_run(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """A run's rows with the items' metadata; items without any have nulls, which no filter matches."""
    rows = spark.read.parquet(path).select("item_id", F.col("embedding").alias("vector"), "content_hash")
    return rows if metadata is None else rows.join(metadata, "item_id", "left")


def sidecar_problems(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, problem) of (path, sha256) against sidecar texts (path with .sha256 behind it, value): missing, or another hash. The hash is the text's first word."""
    named = sidecars.select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("want"))
    joined = files.select("path", "sha256").join(named, "path", "left")
    problem = F.when(F.col("want").isNull(), "no sidecar").when(F.col("want") != F.col("sha256"), "another hash")
    return joined.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def write_index(run: DataFrame, path: str, version: str) -> None:
    """A run's rows as one partition of the index table; a later build of the same version replaces only its own partition."""
    run.withColumn("index_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_version").parquet(path)


def read_index(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One version; only its partition is listed and read."""
    return spark.read.parquet(path).filter(F.col("index_version") == version).drop("index_version")
