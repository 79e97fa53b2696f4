"""Candidate lists as cached values: rows of two fields are responses, rows of four are candidates; the length is the tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_candidates(candidates: DataFrame) -> DataFrame:
    """(query_id, value) of (query_id, item_id, score, popularity, age_days): JSON rows of four, best first."""
    row = F.struct((-F.col("score")).alias("order"), "item_id", "score", "popularity", "age_days")
    text = F.concat(F.lit("["), F.regexp_replace(F.to_json(F.struct(F.col("x.item_id").alias("v"))), r'^\{"v":|\}$', ""), *[p for c in ("score", "popularity", "age_days") for p in (F.lit(","), F.col(f"x.{c}").cast("string"))], F.lit("]"))
    rows = candidates.select("query_id", row.alias("x")).select("query_id", "x.order", "x.item_id", text.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("order", "item_id", "t"))), lambda r: r["t"])
    return rows.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("value"))


def _readable(rows: Column) -> Column:
    """Whether parsed rows are all of two or four fields, begin with an id, and hold numbers after it."""
    sound = lambda r: F.size(r).isin(2, 4) & r[0].isNotNull() & F.forall(F.slice(r, 2, 3), lambda x: x.try_cast("double").isNotNull())
    return F.coalesce(rows.isNotNull() & F.forall(rows, sound), F.lit(False))


def unpack_candidates(values: DataFrame) -> DataFrame:
    """(query_id, item_id, similarity, popularity, age_days) of readable values; responses have no signals."""
    rows = values.withColumn("rows", F.from_json("value", "array<array<string>>"))
    rows = rows.filter(_readable(F.col("rows"))).select("query_id", F.explode("rows").alias("r"))
    number = lambda i: F.get("r", F.lit(i)).cast("double")
    return rows.select("query_id", F.col("r")[0].alias("item_id"), number(1).alias("similarity"), number(2).alias("popularity"), number(3).alias("age_days"))


def unpack_errors(values: DataFrame) -> DataFrame:
    """(query_id, unreadable) of each value: a lookup that finds such a value is an error, not a hit."""
    return values.select("query_id", (~_readable(F.from_json("value", "array<array<string>>"))).alias("unreadable"))
