"""Token counts by offset-mapped attribution.

A whole text is encoded once by a byte-level BPE. The tokens' byte lengths give their byte
offsets and, by counting the bytes that begin a character, their character spans. Sections
(here: lines with their line breaks) are intervals of the same text; sorted interval
bounds are joined with the sorted token starts by binary search. A token that crosses a
border is given to exactly one section by RULE: "first" to the section of its first byte,
"most" to the section that holds most of its bytes, the earlier one in a tie. Counts of the
sections of a text hence always sum to the text's tokens.

Defined results: a null or empty text is one empty section without tokens; an empty line at
the end is a section without tokens; very long texts are encoded whole; a token that crosses several borders
counts once, for the section that the rule names (of equal shares the earlier); repeated rows get their sections
each; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, borders: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses a border. borders: the byte offsets where sections after the first begin."""
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)[: len(token_ends)]
    section = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, token_ends - 1, side="right")
    crossing = np.flatnonzero(last > section)
    if rule == "most":
        for t in crossing:
            edges = np.concatenate([[starts[t]], borders[section[t] : last[t]], [token_ends[t]]])
            section[t] += int(np.argmax(np.diff(edges)))  # the first of equal shares
    crosses = np.zeros(len(starts), dtype=bool)
    crosses[crossing] = True
    return section, crosses


def count_sections(text: str, encoder, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Per section: first character, end character, tokens, crossing tokens; and the text's tokens."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    borders = np.flatnonzero(data == 10) + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = chars[np.concatenate([[0], borders, [len(data)]])]
    ends = np.cumsum(lengths[np.array(encoder.encode_ordinary(text), dtype=np.int64)]) if text else np.empty(0, np.int64)
    section, crosses = attribute(ends, borders, rule)
    n = len(borders) + 1
    return edges[:-1], edges[1:], np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n), len(ends)


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder, lengths = encoding(path, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            done = [count_sections(t or "", encoder, lengths, rule) for t in part.column(1).to_pylist()]
            sizes = np.array([len(d[0]) for d in done])
            row = np.repeat(np.arange(len(done)), sizes)
            nth = np.concatenate([np.arange(n) for n in sizes])
            columns = [np.concatenate([d[k] for d in done]).astype(np.int64) for k in range(4)]
            totals = np.array([d[4] for d in done], dtype=np.int64)[row]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(nth.astype(np.int32)), *map(pa.array, columns), pa.array(totals)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of a public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """One row for each section of each text: its character span, tokens, those of them that cross a border, and the text's tokens."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_count, path=path, pattern=pattern, rule=rule), f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
