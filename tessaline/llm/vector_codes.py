"""Vector codes by integer codebooks, with entries found by VA-file filtering.

Components become whole numbers, floor(SCALE * x); vectors are cut into PARTS equal consecutive
parts, and every part position has a codebook of ENTRIES entries, which starts as that part of the
vectors with the least ids and moves in ROUNDS rounds to the floored means of the parts assigned to it.

The nearest entry of a part is found as in a VA-file. In each dimension the entries'
coordinates are cut into 2 ** BITS cells, equally filled, and an entry is approximated by its cells. For each
vector a lookup table holds its least and greatest squared distance to every cell; sums over
an entry's cells bound its distance from below and above. Only entries whose lower bound does
not exceed the least upper bound are refined by the integer distance, of which the least, then the
lowest index wins. All arithmetic is of whole numbers, so filtering never changes a result.

A round is one pass over the rows, without a shuffle of vectors: tasks send sums and counts of
PARTS x ENTRIES entries, which Spark adds; the driver holds the codebooks only. 64-bit integers are used
where no sum can overflow, as the greatest component shows, and Python's integers beyond.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; vectors are
padded with zeros to the length of the longest, rounded up to a multiple of PARTS (padding adds to no distance),
so empty vectors have code 0 throughout; rows that share a vec_id are vectors of their own, and of equal ids
the one that is less by its components starts a codebook first; null ids start none unless there are too few others (they come last);
with fewer vectors than entries the codebooks are that much shorter; equal entries tie, the lower index wins, and entries
without parts stay; null labels are one label; an error beyond 64 bits becomes the greatest long, as a decimal sum over a
label does; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import cut
from tessaline.session import small

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 2
CHUNK = 2048  # vectors compared at a time
MOST = (1 << 63) - 1
DECIMAL = "decimal(38,0)"


@dataclass
class Codebooks:
    """entries: (PARTS, number, width), of int64, or of Python integers."""

    entries: np.ndarray

    @property
    def exact(self) -> bool:
        return self.entries.dtype == object

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def whole_numbers(column: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """(rows, dim): floor(SCALE * x), padded with zeros. SCALE is a power of two, so the product is exact in double precision."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(column), dim), dtype=object if exact else np.int64)
    if exact:
        values = np.array([int(v) for v in values.tolist()] or [0], dtype=object)[: len(values)]
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def cells(entries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, low, high) of one part position: each entry's cell in each dimension (number, width), and the cells' bounds (width, 2 ** bits), equally filled in the order of the coordinates."""
    number, width = entries.shape
    own = np.empty((number, width), dtype=np.int64)
    count = min(1 << bits, number)
    low, high = np.empty((width, count), dtype=entries.dtype), np.empty((width, count), dtype=entries.dtype)
    for d in range(width):
        order = np.argsort(entries[:, d], kind="stable")
        for c, group in enumerate(np.array_split(order, count)):
            own[group, d] = c
            low[d, c], high[d, c] = entries[group[0], d], entries[group[-1], d]
    return own, low, high


def bounds(x: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, number): lower and upper bounds of the squared distances of x (rows, width) to the entries, from lookup tables over cells."""
    left, right = low[None] - x[:, :, None], x[:, :, None] - high[None]  # (rows, width, cells)
    near = np.maximum(np.maximum(left, right), 0) ** 2
    far = np.maximum(abs(left), abs(right))  # the farther border: |x - low| or |x - high|
    far = far**2
    least, most = np.zeros((len(x), len(own)), dtype=x.dtype), np.zeros((len(x), len(own)), dtype=x.dtype)
    for d in range(x.shape[1]):
        least += near[:, d, own[:, d]]
        most += far[:, d, own[:, d]]
    return least, most


def nearest(x: np.ndarray, entries: np.ndarray, approximation: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of x; ties to the lower index."""
    least, most = bounds(x, *approximation)
    row, entry = np.nonzero(least <= most.min(axis=1)[:, None])  # row by row, entries ascending
    distance = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    first = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(distance, first)
    hit = np.flatnonzero(distance == best[row])
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], best


def assign(x: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, index, squared distance) for each part position of the rows of x, CHUNK rows at a time."""
    width = books.entries.shape[2]
    for p in range(PARTS):
        own = x[:, p * width : (p + 1) * width]
        approximation = cells(books.entries[p])
        found = [nearest(own[i : i + CHUNK], books.entries[p], approximation) for i in range(0, len(own), CHUNK)]
        yield p, own, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that are kept, the vector in double precision."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("vec_id", "label", vector.alias("vector")).filter(F.col("vector").isNotNull()).filter(~bad)


def first_books(kept: DataFrame, dim: int, exact: bool) -> Codebooks:
    """From the vectors with the ENTRIES least ids."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(ENTRIES).toArrow()
    x = whole_numbers(rows.column("vector").combine_chunks(), dim, exact)
    return Codebooks(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2).copy())


def move(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floored means of their parts."""
    number, width = books.entries.shape[1:]
    dim, exact = PARTS * width, books.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, number), dtype=np.int64)
        sums = np.zeros((PARTS, number, width), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, own, index, _ in assign(whole_numbers(batch.column(0), dim, exact), books):
                counts[p] += np.bincount(index, minlength=number)
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                sums[p, used] += np.add.reduceat(own[order], at, axis=0).astype(object)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry]), "sums": pa.array([[str(v) for v in sums[p, e]] for p, e in zip(part, entry, strict=True)], pa.list_(pa.string()))})

    sent = kept.select("vector").mapInArrow(run, "part int, entry int, n bigint, sums array<string>")
    sent = sent.select("part", "entry", "n", *[F.col("sums")[d].cast(DECIMAL).alias(f"s{d}") for d in range(width)])
    total = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(width)])
    entries = books.entries.copy()
    for row in total.collect():  # PARTS x ENTRIES rows
        entries[row.part, row.entry] = [int(row[f"s{d}"]) // row.n for d in range(width)]
    return Codebooks(entries)


def fit(kept: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the kept rows (a DataFrame that is read several times), or None if there are none."""
    shape = kept.agg(F.max(F.size("vector")).alias("dim"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    if shape.dim is None:
        return None
    dim = max(PARTS, -(-shape.dim // PARTS) * PARTS)
    reach = (shape.most or 0.0) * SCALE + 1
    exact = dim * (2 * reach) ** 2 >= 2**62 or CHUNK * 64 * reach >= 2**62
    books = first_books(kept, dim, exact)
    for _ in range(rounds):
        books = move(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries and the squared distance to them."""
    dim, exact = PARTS * books.entries.shape[2], books.exact
    digits = np.array([f"{i:02x}" for i in range(256)])
    types = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, "", dtype="U16"), np.zeros(batch.num_rows, dtype=object if exact else np.int64)
            for _, _, index, distance in assign(whole_numbers(batch.column(2), dim, exact), books):
                code, error = np.char.add(code, digits[index]), error + distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def compress(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors of (vec_id, embedding, label)."""
    kept = cut(usable(rows))
    books = fit(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = cut(encode(kept, books))
    sums = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast(DECIMAL)).alias("sum")).withColumnRenamed("label", "_label"))
    coded = coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label")), "left")
    return coded.select("vec_id", "code", "error", F.least("sum", F.lit(MOST).cast(DECIMAL)).cast("long").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))
