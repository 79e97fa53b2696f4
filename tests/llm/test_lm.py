"""The language model: exact counts, probabilities that sum to one, gradients, and better held-out scores than the base."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessaline.llm import recurrent_lm as lm


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "Eins zwei"), (-3, "word " * 30_000), (-3, "word " * 30_000)], "doc_id long, text string")
    docs = docs.unionByName(extra).selectExpr("*", "1 AS block", "2 AS held")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 4)) for i, t in rows), key=repr)
    got = lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.5 * sum(r.n_tokens for r in own)
    assert lm.score(docs.limit(0)).collect() == []


def vocabulary():
    words = [b"the", b"of", lm.END, b"and", b"to"]
    return lm.Vocabulary(words, np.array([500, 300, 200, 90, 60]), {0: (40, 40), 1: (20, 50), 2: (5, 25)}, 10, 1265, 70)


def small_model():
    v = vocabulary()
    return v, lm.GatedModel(v, v.start().astype(np.float64) + np.random.default_rng(0).standard_normal(len(v.start())) * 0.1)


def ones(h):
    return np.concatenate([h, np.ones((*h.shape[:-1], 1))], axis=-1)


def plain_score(v, w, ids):
    """Natural log probability of one document, token by token, from the formulas."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    S, h, total, previous = lm.STATE, np.zeros(lm.STATE), 0.0, v.end
    for i in ids.tolist():
        gates, own = w["embed"][previous] @ w["wx"] + w["b"], h @ w["wh"]
        z, r = sigmoid(gates[:S] + own[:S]), sigmoid(gates[S : 2 * S] + own[S : 2 * S])
        n = np.tanh(gates[2 * S :] + r * own[2 * S :])
        h = (1 - z) * n + z * h
        logits = ones(h) @ w["wc"]
        k = int(v.class_of[i])
        total += logits[k] - math.log(np.exp(logits).sum())
        if k < v.n_top_classes:
            s, e = v.starts[k], v.starts[k + 1]
            inside = w["wo"][s:e] @ ones(h)
            total += inside[i - s] - math.log(np.exp(inside).sum())
        previous = i
    return total


def test_every_score_of_the_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded, v = lm.encode(docs, str(tmp_path / "lm"), 100_000)
    weights = lm.train(encoded, v)
    w = {k: x.astype(np.float64) for k, x in v.views(weights).items()}
    rows = {r.doc_id: r for r in encoded.collect()}
    got = list(lm._score(iter(encoded.drop("round").toArrow().to_batches()), v, weights))
    for batch in got:
        for r in batch.to_pylist():
            ids = np.frombuffer(rows[r["doc_id"]].inputs, np.uint16)
            assert r["score"] == pytest.approx((plain_score(v, w, ids) + rows[r["doc_id"]].inner) / math.log(10), rel=1e-4)
    assert sum(b.num_rows for b in got) == 200
    assert {r.round for r in rows.values()} == {0, 1, 2, 3} and all(r.held_out == (r.round == 3) for r in rows.values())


def test_counts_do_not_depend_on_blocks(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = [sorted(tuple(r) for r in lm.encode(docs, str(tmp_path / str(n)), n)[0].select("doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("inner", 6), F.md5("inputs")).collect()) for n in (10_000, 1 << 30)]
    assert own[0] == own[1]


def test_probabilities_sum_to_one():
    v, model = small_model()
    counts = np.array([*v.counts, *[1] * 40, *[2] * 10, *[3] * 10, *[5] * 5, 0])
    top = np.array([*range(5), *[-1] * (len(counts) - 5)])
    inputs, inner = v.place(top, counts)
    h = ones(np.tile(np.random.default_rng(1).standard_normal(lm.STATE), (len(counts), 1)))
    assert np.exp(model.outputs(h, inputs) + inner).sum() == pytest.approx(1.0)


def test_logits_beyond_the_range_of_exp():
    x = np.array([[1000.0, 999.0], [-2000.0, -2000.0], [1.0, 2.0]], np.float32)
    total, logs = lm._softmax(x, np.array([0, 1, 1]))
    assert logs.tolist() == pytest.approx([-math.log(1 + math.exp(-1)), -math.log(2), -math.log(1 + math.exp(-1))], rel=1e-5)
    assert (x / total[:, None]).sum(axis=1).tolist() == pytest.approx([1, 1, 1])


def test_gradients():
    v, model = small_model()
    rng = np.random.default_rng(2)
    shape = (5, 3)
    target = rng.integers(0, v.n_inputs, shape)
    inputs, keep, valid = rng.integers(0, v.n_inputs, shape), np.ones(shape), np.ones(shape, bool)
    keep[2, 1], valid[4, 2] = 0, False
    h = rng.standard_normal((3, lm.STATE)) * 0.1

    def loss():
        state, total = h, 0.0
        for t in range(5):
            gates = model.w["embed"][inputs[t]] @ model.w["wx"] + model.w["b"]
            state = model.step(gates, state * keep[t][:, None])
            total -= (model.outputs(ones(state), target[t]) * valid[t]).sum()
        return total / valid.sum()

    gradient = np.zeros_like(model.flat)
    grads = v.views(gradient)
    model.window(inputs, keep, target, valid, h, grads)
    for name, weights in model.w.items():
        for at in rng.choice(weights.size, min(8, weights.size), replace=False):
            flat = weights.reshape(-1)
            old, step = flat[at], 1e-5
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7), name


def test_training_carries_the_state_through_whole_documents(monkeypatch):
    v, model = small_model()
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, v.n_inputs, n).astype(np.uint16) for n in (5000, 3, 40, 700, 1, 90)]
    seen, resets, before = [], 0, {}

    def window(self, inputs, keep, target, valid, h, grads):
        nonlocal resets
        for lane in range(h.shape[0]):
            assert h[lane, 0] == before.get(lane, 0)  # what the last window left
        seen.append(target[valid])
        resets += int((keep == 0)[valid].sum())
        assert (inputs[keep == 0] == v.end).all()
        before.update({lane: rng.random() for lane in range(h.shape[0])})
        return np.array([[before[lane]] * lm.STATE for lane in range(h.shape[0])])

    monkeypatch.setattr(lm.GatedModel, "window", window)
    assert model.train(docs, 1e-3, {}) == sum(map(len, docs))
    assert sorted(np.concatenate(seen).tolist()) == sorted(np.concatenate(docs).tolist())
    assert resets == len(docs)


def test_common_words_have_weights_of_their_own(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(0, text)] * 2, "doc_id long, text string")
    encoded, v = lm.encode(docs, str(tmp_path / "lm"))
    ids = np.frombuffer(encoded.first().inputs, np.uint16)
    assert len(set(ids.tolist())) == 2001 and v.class_of[ids].max() < v.n_top_classes and encoded.first().inner == 0
    assert v.shapes()["wo"] == (2001, 25) and v.shapes()["embed"][1] == 16


def test_average_of_many_tasks_in_a_tree(spark):
    """The weighted mean over more tasks than one group of the tree holds."""
    rng = np.random.default_rng(3)
    rows = [(t, c, int(rng.integers(1, 900)), rng.standard_normal(5).astype(np.float32)) for t in rng.permutation(9000)[:700].tolist() for c in range(2)]
    got = {r.chunk: (r.tokens, np.frombuffer(r.part, np.float32)) for r in lm.average(spark.createDataFrame([(t, c, n, bytearray(w.tobytes())) for t, c, n, w in rows], lm.TRAINED)).collect()}
    for c in range(2):
        own = [(n, w.astype(float)) for _, chunk, n, w in rows if chunk == c]
        assert got[c][0] == sum(n for n, _ in own)
        assert np.allclose(got[c][1], sum(n * w for n, w in own) / sum(n for n, _ in own), atol=1e-5)


def test_a_window_holds_few_arrays_of_all_its_steps():
    v = vocabulary()
    model, shape = lm.GatedModel(v, v.start()), (16, 512)
    ids, ones_, h = np.random.default_rng(0).integers(0, 5, shape).astype(np.uint16), np.ones(shape, np.float32), np.zeros((512, lm.STATE), np.float32)
    tracemalloc.start()
    try:
        model.window(ids, ones_, ids, ones_ > 0, h, v.views(np.zeros_like(model.flat)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 18.5 * 4 * lm.STATE * 16 * 512  # the way back over whole windows took 19.9


def test_windows_take_the_memory_of_earlier_windows():
    v = vocabulary()
    model, shape = lm.GatedModel(v, v.start()), (16, 512)
    ids, ones_, h = np.random.default_rng(0).integers(0, 5, shape).astype(np.uint16), np.ones(shape, np.float32), np.zeros((512, lm.STATE), np.float32)
    model.window(ids, ones_, ids, ones_ > 0, h, v.views(np.zeros_like(model.flat)))
    tracemalloc.start()
    try:
        model.window(ids, ones_, ids, ones_ > 0, h, v.views(np.zeros_like(model.flat)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * 4 * lm.STATE * 16 * 512  # each window took 17.1 of its own


def test_tokens_of_odd_texts():
    texts = ["", None, " \t", " A  b\t\nC ", "\x1c x\x85y  z\x00q\x1f\x0b\x0c\r", "ÄİK K k　", "\n", "a "]
    assert lm.tokens(pa.array(texts)).cast(pa.list_(pa.binary())).to_pylist() == [[w.encode() for w in split(t)] for t in texts]
