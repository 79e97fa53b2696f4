"""The tokenising encoder against a plain version, text by text."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessaline.functions.encoder import TokenEncoder, encode  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "one", "One  ONE", "a somewhat longer text, with punctuation!", "größe 漢字 é", "word " * 700, None, "<|endoftext|>", "one"] + [f"text number {i} " * (i % 40) for i in range(120)]


def plain(text, dim=16, most=64):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    table = np.random.default_rng(0).standard_normal((tokenizer.get_vocab_size(), dim))
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids[:most]
    if not ids:
        return np.eye(dim)[0]
    mean = table[ids].mean(axis=0)
    return mean / np.linalg.norm(mean)


def test_vectors_equal_the_plain_version_whatever_the_batch():
    want = np.array([plain(t) for t in TEXTS])
    first = None
    for batch in (1, 3, 64, 1000):
        got = TokenEncoder(PATH, 16, 64, batch).encode(TEXTS)
        assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-6)
        first = got if first is None else first
        assert (got == first).all()
    assert TokenEncoder(PATH, 16).encode([]).shape == (0, 16)
    with pytest.raises(ValueError):
        TokenEncoder(PATH, batch=0)


def test_truncation_and_a_given_table():
    long = TokenEncoder(PATH, 16, 64)
    assert len(long.tokens(["word " * 700])[0]) == 64 and not np.allclose(long.encode(["a b c d"]), TokenEncoder(PATH, 16, 2).encode(["a b c d"]))
    table = np.ones((60000, 2))
    opened = TokenEncoder(PATH, 2, table=table)
    opened.encode(["open"])
    model = pickle.loads(pickle.dumps(opened))
    assert np.allclose(model.encode(["any text"]), [[2**-0.5, 2**-0.5]])


def test_in_spark(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(5)
    model = TokenEncoder(PATH, 16, 64)
    model.encode(["opened before it is sent"])
    got = {r.i: r.v for r in rows.select("i", encode(F.col("t"), model).alias("v")).collect()}
    assert np.allclose([got[i] for i in range(len(TEXTS))], [plain(t) for t in TEXTS], atol=1e-6)
