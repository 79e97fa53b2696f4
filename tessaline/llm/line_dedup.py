"""Line deduplication by range-partitioned line hashes.

A line's key is the line without ASCII white space at both ends, with A-Z in lower
case. A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
documents loses all its lines but those in the largest doc_id that holds it.

Line hashes are range-partitioned and sorted by (hash, doc_id descending, position), so
that one streaming pass of a window over each hash meets the surviving document first
and marks what follows. A range partition cannot be split below one hash, so hashes
with more than HOT_LINES lines, at any size of the table, take a map-side aggregation instead; the set of these
hashes is broadcast up to BROADCAST_KEYS of them and joined by a shuffle beyond. The result is a
run-length compressed keep bitmap for each document, not text; ``apply_keep_runs`` turns it into text.

Defined results: a null or empty text is one empty line and is kept; very long texts and lines are
handled whole; rows that share a doc_id are one document for counting, and each row gets its own bitmap, so
equal lines within the largest doc_id all stay; a row with a null
doc_id neither counts nor loses lines; other columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm.common import ASCII_SPACE, cut, lower_ascii

HOT_LINES = 1000  # a key with more lines does not go through one partition
BROADCAST_KEYS = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, rid, pos) for every line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("rid"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = lower_ascii(F.trim("line", F.lit(ASCII_SPACE)))
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", key).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "rid", "pos")


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, rid, pos) of the lines that go."""
    hot = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    hot = cut(hot.filter(F.col("n") > HOT_LINES).select("h1", "h2", "first", "last"))
    bounded = F.broadcast if hot.count() <= BROADCAST_KEYS else lambda keys: keys
    by_key = Window.partitionBy("h1", "h2")

    cold = lines.join(bounded(hot), ["h1", "h2"], "left_anti").filter(F.col("doc_id").isNotNull())
    cold = cold.repartitionByRange("h1", "h2")
    cold = cold.withColumn("nth", F.dense_rank().over(by_key.orderBy(F.desc("doc_id"))))
    cold = cold.withColumn("docs", F.max("nth").over(by_key)).filter((F.col("docs") >= min_docs) & (F.col("nth") > 1))

    mine = lines.join(bounded(hot), ["h1", "h2"])
    spread = mine.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"))
    spread = spread.filter(F.col("docs") >= min_docs).select("h1", "h2")  # no more rows than hot
    busy = mine.join(bounded(spread), ["h1", "h2"]).filter(F.col("doc_id") < F.col("last"))
    return cold.select("doc_id", "rid", "pos").unionByName(busy.select("doc_id", "rid", "pos"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run-length keep bitmap: (start, length) of each run of kept lines, from sorted 0-based dropped positions."""
    ends = F.concat(dropped, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, rid, dropped) for each row that loses lines: sorted 0-based positions. rid is xxhash64(text)."""
    lines = cut(line_keys(docs.select("doc_id", "text"), min_chars))
    return dropped_lines(lines, min_docs).groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def apply_keep_runs(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and kept_text, which replace columns of these names; marks comes from dedup_lines."""
    docs = docs.drop("n_lines", "n_dropped", "keep_runs", "kept_text", "_doc", "_rid", "_dropped", "_lines", "_gone", "_runs")
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), F.col("dropped").alias("_dropped"))
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_rid")), "left")
    own = [F.col(c) for c in docs.columns]
    lines, gone = lines_of(F.col("text")), F.coalesce(F.col("_dropped"), F.array().cast("array<int>"))
    joined = joined.select(*own, lines.alias("_lines"), gone.alias("_gone"))
    joined = joined.withColumn("_runs", keep_runs(F.size("_lines"), F.col("_gone")))
    kept = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice("_lines", r["start"] + 1, r["length"]))), "\n")
    kept = F.when(F.size("_gone") == 0, F.coalesce("text", F.lit(""))).otherwise(kept)
    return joined.select(*own, F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), F.col("_runs").alias("keep_runs"), kept.alias("kept_text"))
