"""SHA-256 over the rows of each key in order, without a value that holds them.

Rows are dealt by ranges of (keys, order), so that a key with most of the rows is spread as well. Each
task joins its rows, as they stream by in order, to chunks of about CHUNK bytes. The chunks of a key, a few
thousandths of its rows, then stream in order through one hash state. The
hash of a sequence is sequential by definition; that last pass holds one chunk and one state at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 8192  # bytes


def _rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key, last column) of every row."""
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        own = zip(*columns[:keys], strict=True) if keys else iter([()] * batch.num_rows)
        yield from zip(own, columns[-1], strict=True)


def _emit(keys: list, values: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*keys, strict=True)] if keys and keys[0] else []
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *values], schema, strict=True)], schema=schema)


def ordered_sha256(rows: DataFrame, keys: list[str], order: list[Column], piece: Column, separator: str = "") -> DataFrame:
    """(keys, sha256): lowercase hex of the hash of piece (string) joined by separator, in the given order. Rows that tie in the order should be equal in piece."""
    n, gap = len(keys), separator.encode()
    names = [f"_o{i}" for i in range(len(order))]
    own = rows.select(*keys, *[c.alias(x) for c, x in zip(order, names, strict=True)], piece.cast("binary").alias("piece"))
    dealt = own.repartitionByRange(*keys, *names).sortWithinPartitions(*keys, *names).select(*keys, "piece")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = dict(rows.dtypes)
    key_fields = [pa.field(k, arrow[types[k]]) for k in keys]
    key_ddl = "".join(f"`{k}` {types[k]}, " for k in keys)
    chunk_schema = pa.schema([*key_fields, pa.field("part", pa.int32()), pa.field("seq", pa.int64()), pa.field("chunk", pa.binary())])
    hash_schema = pa.schema([*key_fields, pa.field("sha256", pa.string())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for key, group in groupby(_rows(batches, n), key=lambda r: r[0]):
            held, size = [], 0
            for _, value in group:
                held.append(value)
                size += len(value) + len(gap)
                if size >= CHUNK:
                    yield _emit([key], [[part], [seq], [gap.join(held)]], chunk_schema)
                    held, size, seq = [], 0, seq + 1
            if held:
                yield _emit([key], [[part], [seq], [gap.join(held)]], chunk_schema)
                seq += 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_rows(batches, n), key=lambda r: r[0]):
            state, first = hashlib.sha256(), True
            for _, chunk in group:
                if not first:
                    state.update(gap)
                state.update(chunk)
                first = False
            yield _emit([key], [[state.hexdigest()]], hash_schema)

    chunks = dealt.mapInArrow(pack, f"{key_ddl}part int, seq bigint, chunk binary")
    met = chunks.repartition(*keys) if keys else chunks.repartition(F.lit(0))
    return met.sortWithinPartitions(*keys, "part", "seq").select(*keys, "chunk").mapInArrow(digest, f"{key_ddl}sha256 string")
