"""White space and the head of long texts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessaline.functions import text

CLASS = re.compile(r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]+")


def test_white_space_is_that_of_unicode(spark):
    points = [(c, f"a{chr(c)}b") for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    got = {r.c: r.t for r in spark.createDataFrame(points, "c int, t string").select("c", text.collapse(F.col("t")).alias("t")).collect()}
    assert all(got[c] == CLASS.sub(" ", t).strip(" ") for c, t in points)


def test_item_text_reads_no_further_than_it_takes(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["a", "bc", " ", "  ", "\t", "\n\n", "é", " ", " " * 700]) for _ in range(n))
    rows = [(i, make(rng.choice([0, 1, 5, 300, 3000])), make(rng.choice([0, 1, 5, 300, 3000]))) for i in range(300)]
    rows += [(400, " " * 5000 + "x", "y" * 600), (401, "t" * 511, "d"), (402, "t" * 512, "d"), (403, "t" * 513, "d"), (404, "", "z " * 2000)]
    for normalise in (True, False):
        got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", text.item_text(F.col("a"), F.col("b"), normalise).alias("t")).collect()}
        for i, a, b in rows:
            a, b = (CLASS.sub(" ", s).strip(" ") for s in (a, b))
            assert got[i] == (f"{a} | {b}" if b else a)[:512].strip(" "), i
