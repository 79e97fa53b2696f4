"""Removal of long repeats against sets of byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tessaline.llm import run_index


def plain(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                first[data[i : i + 50]] = min(doc, first.get(data[i : i + 50], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < doc:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=120):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "rün", "sto", "be") for b in ("ne", "ch", "ll", "🙂", "q")]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(6)]
    rows = [(1000, None), (1001, ""), (None, passages[0]), (None, passages[0]), (1002, "a" * 500), (1003, "a" * 49), (1004, "a" * 51), (1005, "ab" * 400), (1006, "b" + "ab" * 30), (1007, "\x00" * 60), (1008, "\x00" * 70)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
            s = rng.randrange(0, max(1, len(p) // 3))
            parts.append(p[s : s + rng.randrange(10, 400)])
        rows.append((i, rng.choice("\n .").join(parts)))
    return [*rows, rows[20], (17, rows[30][1]), (2000, rows[40][1]), (2001, rows[40][1]), (5000, "x".join(r[1] or "" for r in rows))]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, block int")
    return sorted(map(tuple, run_index.remove_repeats(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500, "chunk": 300}, {"block_bytes": 3000, "hot": 4}])
def test_repeats(spark, options):
    rows = corpus()
    assert run(spark, rows, **options) == plain(rows)


def test_repeats_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == plain([(1, None)])


def words(rng, alphabet, n, low, high):
    return [bytes(rng.choice(alphabet) for _ in range(rng.randrange(low, high))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256)), b"\x00\xff"])
def test_matching_statistics_of_foreign_texts(alphabet):
    """Queries that are not indexed, pieces of indexed texts among them, against a dictionary of windows."""
    rng = random.Random(4)
    texts = [*words(rng, alphabet, 30, 50, 120), b"ab" * 60, b"a" * 70, b"\xff" * 55]
    docs = np.array([rng.randrange(9) for _ in texts])
    queries = [*words(rng, alphabet, 20, 1, 90), b"", b"zz", b"ab" * 40, b"\x00" * 60]
    for _ in range(30):
        a, b = rng.choice(texts), rng.choice(texts)
        queries.append(a[rng.randrange(20) :] + bytes(rng.choice(alphabet) for _ in range(rng.randrange(3))) + b[rng.randrange(20) :])
    first = {}
    for text, doc in zip(texts, docs):
        for i in range(len(text) - 49):
            first[text[i : i + 50]] = min(doc, first.get(text[i : i + 50], doc))
    index = run_index.RunLengthIndex(texts, docs)
    got = {(int(q), int(o)): int(d) for who, where, least in index.stream(queries) for q, o, d in zip(who, where, least)}
    assert got == {(q, i): first[text[i : i + 50]] for q, text in enumerate(queries) for i in range(len(text) - 49) if text[i : i + 50] in first}


def test_index_is_run_compressed():
    rng = random.Random(5)
    base = bytes(rng.randrange(97, 123) for _ in range(400))
    texts = [base[rng.randrange(50) : 350 + rng.randrange(50)] for _ in range(60)]  # repetitive
    index = run_index.RunLengthIndex(texts, np.arange(60))
    size, runs = sum(len(t) + 1 for t in texts), len(index.run_start)
    assert runs < size / 10 and len(index.least_start) < size / 5
    assert all(len(getattr(index, name)) == runs for name in ("run_symbol", "run_last", "first_sample", "last_sample", "target"))
    for sample in (index.first_sample, index.last_sample):
        assert (index.symbols[sample - 1][sample > 0] == index.run_symbol[sample > 0]).all()


def test_buckets_gather_what_blocks_send(spark):
    """Many blocks and few documents: messages go to buckets with keys only, and the result does not change."""
    rows = corpus(40)
    assert run(spark, rows, block_bytes=200) == plain(rows)


def messages(rows, hot=1 << 16):
    """What one block of these rows sends."""
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    asked = run_index.send_keys(0, table, 4)
    answers = pa.concat_tables([run_index.answer_keys(b, asked.filter(pa.compute.equal(asked["bucket"], b)), hot) for b in set(asked["bucket"].to_pylist())])
    return run_index.send_segments(0, table, answers, 4).to_pylist()


LINE = "The quick brown fox jumps over the lazy dog while seventy others sit.\n"


@pytest.mark.parametrize("times", [2_000, 20_000])
def test_copies_within_a_document_are_sent_once(times):
    sent = [r for r in messages([(1, LINE * times), (2, LINE * 2)]) if r["texts"] is not None]
    segments = sum(len(r["lengths"]) // 4 for r in sent)
    assert segments <= 10 and sum(len(r["texts"]) for r in sent) < 2_000
    assert sum(len(r["copies"] or b"") for r in sent) < 12 * 5 * times  # places only


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2_000}, {"block_bytes": 2_000, "hot": 8}])
def test_a_line_repeated_within_documents(spark, options):
    """In the least document, in later ones, and in rows that share a doc_id; of copies in one document all or none go."""
    rows = [(5, LINE * 40), (7, "head\n" + LINE * 30 + "tail"), (7, LINE * 3 + "another"), (9, LINE + "x" * 20 + LINE[:55]), (2, "nothing of the kind"), (11, LINE * 25), (11, None)]
    assert run(spark, rows, **options) == plain(rows)
    rows += [(1, "..." + LINE[5:62] + "...")]  # now a part of it starts before
    assert run(spark, rows, **options) == plain(rows)


def test_a_key_of_one_document_is_hot_by_its_segments():
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array([LINE * 300, LINE], pa.string())})
    asked = run_index.send_keys(0, table, 1)
    answer = run_index.answer_keys(0, asked, 100)
    assert any(b"\1" in h for h in answer["hot"].to_pylist())
    assert not any(b"\1" in h for h in run_index.answer_keys(0, asked, 4096)["hot"].to_pylist())
