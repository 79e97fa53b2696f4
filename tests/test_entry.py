"""The driver's contract."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")]


def rounded(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(rounded, value)) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(rows.columns)
    key = lambda r: repr(r)
    assert sorted((rounded(tuple(r[c] for c in columns)) for r in rows.collect()), key=key) == sorted(map(rounded, found.fetchall()), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q)); print(any(n.startswith('op') or n == 'pipeline' for n in {**q, **o}))"


def listed(folder, code=LIST):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, capture_output=True, text=True).stdout.split()
    return int(out[-2]), out[-1] == "True"


def test_the_rest_does_without_the_llm_folders(tmp_path):
    names = list(__spark_entry__.queries())
    rest = [n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert listed(tmp_path / "copy") == (len(rest), False)


def test_the_rest_does_without_what_the_llm_folder_imports():
    found, some = listed(ROOT, "import sys; sys.modules['xxhash'] = None; " + LIST)
    assert found > 90 and not some
