"""Text encoders: an interface, and a deterministic one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    """What an encoder offers: a version, a dimension, and unit vectors for a batch of texts."""

    model_version: str
    embedding_dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of lower-case words; the zero vector of an empty text becomes the first axis."""

    def __init__(self, embedding_dim: int = 64):
        self.embedding_dim = embedding_dim
        self.model_version = f"hashing-{embedding_dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.embedding_dim), dtype=np.float64)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                out[row, h % self.embedding_dim] += 1 if h >> 63 else -1
            size = np.linalg.norm(out[row])
            if size < 1e-12:
                out[row, 0], size = 1.0, 1.0
            out[row] /= size
        return out.astype(np.float32)


class TokenEncoder:
    """Mean of token vectors: subword tokens of a vocabulary file, the first max_tokens of them, padded to the next power of two, pooled under a mask, of length 1.

    Token vectors follow from a seed, so that no model file is needed; a trained table of (tokens, dim) may be given instead.
    Texts are pooled in groups of one padded length, batch rows at a time; a text's vector
    does not depend on the others. A text without tokens becomes the first axis. The vocabulary is read once for each worker.
    """

    def __init__(self, vocabulary: str, embedding_dim: int = 64, max_tokens: int = 256, batch: int = 256, seed: int = 0, table: np.ndarray | None = None):
        if batch < 1 or max_tokens < 1:
            raise ValueError("batch and max_tokens must be positive")
        self.vocabulary, self.embedding_dim, self.max_tokens, self.batch, self.seed = vocabulary, embedding_dim, max_tokens, batch, seed
        self.model_version = f"tokens-{embedding_dim}-{max_tokens}-{seed}"
        self.table, self._tokenizer, self._vectors = table, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tokenizer": None, "_vectors": None}  # a worker makes its own

    def _open(self) -> None:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.vocabulary)
            tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
            size = tokenizer.get_vocab_size(with_added_tokens=True)
            self._vectors = np.random.default_rng(self.seed).standard_normal((size, self.embedding_dim)) if self.table is None else self.table
            self._tokenizer = tokenizer

    def tokens(self, texts: list[str]) -> list[list[int]]:
        self._open()
        return [e.ids[: self.max_tokens] for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.embedding_dim))
        for start in range(0, len(texts), self.batch):
            ids = self.tokens([t or "" for t in texts[start : start + self.batch]])
            groups: dict[int, list[int]] = {}
            for row, own in enumerate(ids):
                if own:
                    groups.setdefault(1 << (len(own) - 1).bit_length(), []).append(row)
            for width, rows in groups.items():
                padded = np.zeros((len(rows), width), dtype=np.int64)
                mask = np.zeros((len(rows), width))
                for i, row in enumerate(rows):
                    padded[i, : len(ids[row])], mask[i, : len(ids[row])] = ids[row], 1.0
                out[start + np.array(rows)] = np.einsum("nld,nl->nd", self._vectors[padded], mask) / mask.sum(axis=1, keepdims=True)
        size = np.linalg.norm(out, axis=1)
        out[size < 1e-12, 0] = 1.0
        return (out / np.where(size < 1e-12, 1.0, size)[:, None]).astype(np.float32)


def encode(text: Column, encoder: Encoder) -> Column:
    """Vectors of a text column in Arrow batches; the encoder is set up once for each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encoder.encode(batch.fillna("").tolist())), index=batch.index)

    return run(text)
