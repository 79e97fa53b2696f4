"""Benchmark decontamination by winnowing.

Texts become lists of words (runs of ASCII letters and digits and of any non-ASCII
characters, A-Z in lower case). Of the hashes of all K-grams of words, the least in each
sliding window of WINDOW hashes is a fingerprint. A span of K + WINDOW - 1 = 13 shared
words holds one whole window of hashes, so both sides keep the same K-gram of it: every
shared span is found. Documents with a fingerprint in common with the benchmark are
extended: all their 13-word windows are compared with those of the benchmark by a 128-bit
hash. Items of fewer words are one window of their own length; K-grams of that very length
serve as fingerprints, without winnowing, as no shorter guarantee would do.

The benchmark side is broadcast when it has at most BROADCAST_WINDOWS windows, and
joined by a shuffle beyond that.

Defined results: null or wordless texts have no words, no hits and the hash of an empty
list; very long texts are searched whole; items without words are ignored; items that share an id count once, and of
items with the same window all count; rows that share doc_id and text get the same result each; other
columns are ignored, whatever their names (the result's replace those of the documents); empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm.common import cut, lower_ascii

SPAN, K = 13, 8
WINDOW = SPAN - K + 1
BROADCAST_WINDOWS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _mix(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _lesser(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _pairs(a: Column, step: int, combine) -> Column:
    """combine(a[i], a[i + step]) for all i; empty if there are too few."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.slice(F.zip_with(a, F.slice(a, step + 1, n), combine), 1, n)


def with_hashes(rows: DataFrame, prefix: str, salt: str = "") -> DataFrame:
    """rows with the hashes of all runs of 1, 2, 4 and 8 words, each from two shorter ones. Every level is a column, so that none is computed twice."""
    own = [F.lit(salt)] if salt else []
    rows = rows.withColumn(f"{prefix}1", F.transform("words", lambda w: F.xxhash64(*own, w)))
    for size in (1, 2, 4):
        rows = rows.withColumn(f"{prefix}{2 * size}", _pairs(F.col(f"{prefix}{size}"), size, _mix))
    return rows


def grams(prefix: str, k: int) -> Column:
    """Hashes of all k-grams of words, in order, k from 1 to 15; empty if there are fewer words."""
    n = F.greatest(F.size(f"{prefix}1") - (k - 1), F.lit(0))
    out, at = None, 0
    for size in (8, 4, 2, 1):
        if k & size:
            part = F.slice(F.col(f"{prefix}{size}"), at + 1, n)
            out = part if out is None else F.zip_with(out, part, _mix)
            at += size
    return out


def with_winnowed(rows: DataFrame, hashes: Column) -> DataFrame:
    """rows with f, the least hash of each window of WINDOW hashes, each value once: the least of two windows of four that overlap."""
    rows = rows.withColumn("m2", _pairs(hashes, 1, _lesser))
    rows = rows.withColumn("m4", _pairs(F.col("m2"), 2, _lesser))
    return rows.withColumn("f", F.array_distinct(_pairs(F.col("m4"), WINDOW - 4, _lesser))).drop("m2", "m4")


def _bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, rid, n_hit, items) for each row with a hit; rid is xxhash64(text), items the sorted ids as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(SPAN)))
    short = sorted(r.width for r in items.select("width").distinct().collect() if r.width < SPAN)  # twelve at most
    hashed = cut(with_hashes(with_hashes(items, "a"), "b", "second"))  # read several times
    both = lambda n: F.arrays_zip(grams("a", n).alias("h1"), grams("b", n).alias("h2"))
    per_width = [hashed.filter(F.col("width") == n).select("item", F.lit(n).alias("width"), F.explode(both(n)).alias("w")) for n in [*short, SPAN]]
    windows = per_width[0]
    for more in per_width[1:]:
        windows = windows.unionByName(more)
    windows = cut(windows.select("width", "w.*", "item").groupBy("width", "h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("m")).first()
    small = max(size.n, size.m) <= BROADCAST_WINDOWS

    long_items = with_winnowed(hashed.filter(F.col("width") == SPAN), grams("a", K)).select(F.explode(F.concat("f")).alias("f"))  # of a plain column the optimizer infers a filter, and copies all levels into it
    seeds = long_items.unionByName(windows.filter(F.col("width") < SPAN).select(F.col("h1").alias("f"))).distinct()

    base = docs.select("doc_id", F.xxhash64("text").alias("rid"), words_of(F.col("text")).alias("words"))
    found = with_winnowed(with_hashes(base, "a"), grams("a", K))
    found = found.select("doc_id", "rid", F.explode(F.concat("f", *[grams("a", n) for n in short])).alias("f"))
    found = found.join(_bounded(seeds, small), "f", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid")).distinct()

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("rid"))
    texts = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left_semi")
    texts = with_hashes(with_hashes(texts.select("doc_id", "rid", words_of(F.col("text")).alias("words")), "a"), "b", "second")
    spans = None
    for n in [*short, SPAN]:
        one = texts.select("doc_id", "rid", F.lit(n).alias("width"), F.posexplode(both(n)).alias("start", "w")).select("doc_id", "rid", "width", "start", "w.*")
        spans = one if spans is None else spans.unionByName(one)
    hits = spans.join(_bounded(windows, small), ["width", "h1", "h2"]).select("doc_id", "rid", "start", (F.col("start") + F.col("width")).alias("end"), "items").distinct()
    before = Window.partitionBy("doc_id", "rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))
    return hits.groupBy("doc_id", "rid").agg(F.sum(fresh).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, items and contaminated (a twentieth of the words or more is hit), which replace columns of these names."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated", "_doc", "_rid", "_hit", "_items")
    hits = contamination(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), F.col("n_hit").alias("_hit"), F.col("items").alias("_items"))
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_rid")), "left")
    own = [F.col(c) for c in docs.columns]
    joined = joined.select(*own, F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
