"""Results that hang on the last bit: ties of means, and the sign of a rounded nothing."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.mark.parametrize("values", [(0.1, 0.2, 0.3), (1e18, 0.5, 1.5), (float("inf"), 1.0, 2.0)])
def test_groups_of_equal_means_are_tied(spark, tmp_path, values):
    rows = [(i, 0, "view", v) for i, v in enumerate(values)] + [(10 + i, 60, "view", v) for i, v in enumerate(reversed(values))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["ext_holm"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("third 0", "view", 2 / 41, True)]


def test_rounded_vectors_keep_their_signs(spark, tmp_path):
    """Documents 108 to 110 at sf0.1 make a vector with a component between -0.00005 and 0."""
    spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.col("doc_id").between(105, 113)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {q: list(map(repr, v)) for q, v in connection.execute(SQL["v4_encoded_queries"]).fetchall()}
    assert any("-0.0" in v for v in want.values())
    assert {r.query_id: list(map(repr, r.vector)) for r in QUERIES["v4_encoded_queries"](spark, str(tmp_path)).collect()} == want
