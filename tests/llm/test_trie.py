"""The prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessaline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)))) for n, m in members.items()),
        key=repr,
    )


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r[c] for c in OUT) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


ODD = [
    (0, 0, "system", "be brief"), (0, 1, "user", "hello there"), (0, 2, "assistant", "hi"), (0, None, "user", "first of all"), (0, None, None, None),
    (1, 0, "user", "own"), (1, 1, "user", "own two words"), (1, 2, "user", "x"), (1, 3, "user", "tail of one"), (2, 5, "user", "short"),
    (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "b"), (3, 0, "assistant", "a"), (3, 1, "u", ""), (45, 0, "user", "no base"), (45, 1, "user", "still none"),
    (46, 0, "u", "x"), (47, 0, "u", "x"), (47, 1, "u", "y"), (47, 2, "u", "z"), (47, 3, "u", "end"), (None, 0, "user", "nobody"), (-7, 0, "u", "below"), (-7, 1, "u", "zero"), (-20, 0, "u", "base"), (-20, 1, "u", "two"),
    (60, 0, "u", "long " * 50000), (61, 0, "u", "long " * 50000), (61, 1, "u", "long " * 50000), (61, 2, "u", "q"), (61, 3, "u", "q"),
]


def made(seed, convs=300, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(words)))) for c in range(convs) for t in range(rng.randrange(1, 9))]


def test_trie_equals_plain_python(spark):
    assert found(spark, ODD) == plain(ODD)
    rows = made(1)
    assert found(spark, rows) == plain(rows)


def test_segments_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "HOT_ENDS", 2)
    rows = made(2) + [(400 + i, t, "user", f"t{t}") for i in range(40) for t in range(10)]
    assert found(spark, rows, 11) == plain(rows)


def test_a_conversation_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 64)
    rows = [(7, t // 3, "user", f"turn {t}") for t in range(2000)] + made(3, 60) + [(8, 0, "user", "same")] * 500
    assert found(spark, rows, 9) == plain(rows)


def test_nested_snapshots_take_few_rounds(spark):
    rows = [(20 * i, t, "user", f"t{t}") for i in range(30) for t in range(i + 1)]  # each extends the one before
    assert found(spark, rows) == plain(rows)


def test_empty_table_and_only_null_ids(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "user", "x")])


def test_conversations_as_they_are(spark):
    turns = spark.createDataFrame([(1, 1, "u", b"a", 2), (2, 1, "u", b"a", 2), (2, 2, "u", b"b", 1)], "conv_id long, depth int, role string, digest binary, n_words int")
    lengths = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "conv_id long, length int")
    rows = {(r.conv_id, r.depth): (r.n_convs, r.n_leaves, r.saved_tokens, r.n_ends) for r in prefix_trie.trie(lengths, turns).collect()}
    assert rows == {(1, 0): (3, 1, 2, 1), (1, 1): (2, 1, 2, 1), (2, 2): (1, 1, 0, 1)}


@pytest.mark.parametrize("conv_id", [0, 7, -20, 123456789])
def test_head_length_is_the_crc(spark, conv_id):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(conv_id).cast("long").alias("conv_id")).select(prefix_trie.head_length(F.col("conv_id")).alias("h")).first()
    assert row.h == zlib.crc32(str(conv_id).encode()) % 4
