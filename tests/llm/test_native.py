"""Line dedup and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessaline.llm import decontaminate, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_line_dedup(docs):
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 20:
                holders[key].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            own = {d for d in holders.get(lower(line.strip(SPACE)), ()) if d is not None}
            if not (len(own) >= 3 and doc is not None and doc < max(own)):
                keep.append(line)
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


LINE = "This line is long enough to count"
DOCS = [
    (1, f"{LINE}\nshort\n  {LINE.upper()} \t\nown text of one"),
    (2, f"head\n{LINE}\n\n"),
    (3, f"{LINE}"),
    (4, None),
    (5, ""),
    (6, "Éxact accents stay as they ARE here\nx"),
    (7, "éxact accents stay as they ARE here\nx"),
    (8, "Éxact accents stay as they ARE here"),
    (9, "Éxact accents stay as they are HERE\n" + "\n".join([LINE] * 3)),
    (None, LINE),
    (10, "\n".join(f"line number {i} of a very long text" for i in range(3000))),
    (11, "\n".join(f"line number {i} of a very long text" for i in range(0, 3000, 2))),
    (12, "\n".join(f"line number {i} of a very long text" for i in range(0, 3000, 3))),
]


def run_lines(spark, rows, **extra):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_lines int, _rid int")
    kept = line_dedup.apply_keep_runs(docs, line_dedup.dedup_lines(docs))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in kept.collect()), key=repr)


def test_line_dedup(spark):
    assert run_lines(spark, DOCS) == plain_line_dedup(DOCS)


def test_line_dedup_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    assert run_lines(spark, DOCS) == plain_line_dedup(DOCS)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)  # joined by a shuffle
    assert run_lines(spark, DOCS) == plain_line_dedup(DOCS)


def test_line_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, LINE), (1, LINE), (2, LINE)]
    assert [r[2] for r in run_lines(spark, rows)] == [0, 0, 0]  # two documents only
    assert [r[2] for r in run_lines(spark, [*rows, (3, LINE)])] == [1, 1, 1, 0]
    assert run_lines(spark, []) == []


def plain_decontaminate(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run_decontaminate(spark, docs, items):
    d = spark.createDataFrame([(a, b, 0, "x") for a, b in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(a, c, 1) for a, c in items], "item_id long, text string, doc_id int")
    r = decontaminate.decontaminate(d, b).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    return sorted(((x.doc_id, x.n_words, x.n_hit, len(x["items"]), x.sha, x.contaminated) for x in r.collect()), key=repr)


ITEMS = [
    (1, " ".join(f"alpha{i}" for i in range(20))),
    (2, "Three short words"),
    (10, " ".join(f"alpha{i}" for i in range(5, 25))),
    (3, None),
    (4, "  ... "),
    (5, "one"),
    (5, "one"),
    (6, " ".join(["same"] * 15)),
    (7, "a b c d e f g h i j"),
]
TEXTS = [
    (1, "intro " + " ".join(f"Alpha{i}," for i in range(4, 18)) + " outro"),
    (2, " ".join(f"alpha{i}" for i in range(12))),
    (3, "so three SHORT words, and one"),
    (4, None),
    (5, ""),
    (6, " ".join(["same"] * 14)),
    (7, "É " * 300 + " ".join(f"alpha{i}" for i in range(20))),
    (8, "x a-b-c-d-e-f-g-h-i-j y"),
    (8, "x a-b-c-d-e-f-g-h-i-j y"),
    (None, "one"),
    (9, " ".join(f"w{i % 97}" for i in range(20000)) + " " + " ".join(f"alpha{i}" for i in range(13))),
]


def test_decontaminate(spark):
    assert run_decontaminate(spark, TEXTS, ITEMS) == plain_decontaminate(TEXTS, ITEMS)


def test_decontaminate_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert run_decontaminate(spark, TEXTS, ITEMS) == plain_decontaminate(TEXTS, ITEMS)


def test_decontaminate_without_items_or_documents(spark):
    assert run_decontaminate(spark, TEXTS, []) == plain_decontaminate(TEXTS, [])
    assert run_decontaminate(spark, [], ITEMS) == []
