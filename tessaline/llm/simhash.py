"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints: A-Z in lower case, words are runs of non-space bytes (ASCII white space),
shingles of SHINGLE words (or a given number) joined by one space, repeats included; a text of fewer words is one
shingle of them all, a text without words has fingerprint zero. A bit is 1 if it is set in
over half of the shingles' XXH64 (seed 42) hashes. Two fingerprints link at THRESHOLD (or a given number) or
fewer differing bits.

Candidates: equal fingerprints are one row from the start. Correlated bits, by their
co-occurrence over all fingerprints, go to the same partition. Thresholds t_i per partition
with sum THRESHOLD - m + 1 (-1: not probed) keep every pair: some partition differs in no
more than its t_i bits. Dynamic programming picks the thresholds with the fewest
candidates, by the number of equal pairs counted in each partition and the share of pairs
that one more differing bit adds, plus the probes themselves; the number of partitions m is
the cheapest of 2 to THRESHOLD + 2. A row is indexed by its partition's value and probes all values
within t_i bits. Values that more than HOT fingerprints share are split into
parts of the other bits, of which a linked pair shares one, and again until no value has more, or FREE bits
or fewer are left to differ, so no task meets a hot value whole. Pairs are verified
in numpy within one value: with the rows that follow, or, where a value still has more rows than
there are fingerprints within reach, by looking these up. A task emits a spanning forest, not all pairs.

Defined results: null and empty texts have fingerprint zero and link with one another; very
long texts are hashed whole; repeated rows, and rows that share a doc_id with different texts, are
one node, which links what any of them links, and each gets its row; rows with a null doc_id link with
nothing and have a null component; other columns are ignored, whatever their names; an empty table works.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import LOWER, UPPER, cut
from tessaline.llm.components import connected_components, local_roots

BITS, THRESHOLD, SHINGLE, SEED = 64, 2, 3, 42
HOT = 4096
FREE = 12  # bits, whose values are no more than HOT
LOOK_UP = 8192  # rows of a value from which looking up may be less work than comparing
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = str.maketrans(UPPER, LOWER)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = WORD.findall((text or "").translate(TO_LOWER) if not (text or "").isascii() else text.lower()) if text else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    set_in = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        set_in += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * set_in > len(hashes)))


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        prints = np.fromiter((fingerprint(texts[i].as_py(), size) for i in range(len(texts))), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_fingerprints, size=size), "doc_id long, fp long")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)  # exact: a batch has far fewer than 2^24 rows
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "both"])


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m groups of nearly equal size; a group grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        first = max(sorted(left), key=lambda b: sum(alike[b, list(left)]))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: alike[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(counts: list[list[float]], total: int) -> tuple[float, list[int]] | None:
    """Thresholds from -1 to len(row) - 2, one for each row of counts, with the given sum and the least sum of counts; None if none have the sum."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in counts:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                new = (cost + row[t + 1], [*chosen, t])
                if spent + t not in step or new[0] < step[spent + t][0]:
                    step[spent + t] = new
        best = step
    return best.get(total)


def part_value(fp, bits: list[int]):
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def equal_pairs(distinct: DataFrame, groups: list[list[int]]) -> Iterator[float]:
    """For each group of bits the pairs of fingerprints that are equal in it, all from one job."""
    values = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), part_value(F.col("fp"), own).alias("v")) for j, own in enumerate(groups)]))
    counts = distinct.select(values.alias("x")).groupBy("x.j", "x.v").agg(F.count("*").cast("double").alias("c")).groupBy("j").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    found = {r.j: r.pairs for r in counts.collect()}  # a row for each group
    return iter([found.get(j, 0.0) for j in range(len(groups))])


def plan(distinct: DataFrame, bits: int = THRESHOLD) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and the threshold of each, from counts over all fingerprints."""
    sums = distinct.select("fp").mapInArrow(_moments, "i long, j long, both long").groupBy("i", "j").agg(F.sum("both").alias("both")).collect()  # 64 x 64 rows
    both = np.zeros((BITS, BITS))
    for r in sums:
        both[r.i, r.j] = r.both
    n = distinct.count()
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p**2 + (1 - p) ** 2, 1e-3, 1)
    plans = [group_bits(both, n, m) for m in range(2, bits + 3)]
    same = equal_pairs(distinct, [own for groups in plans for own in groups])
    best = None
    for groups in plans:
        counts = []
        for own in groups:
            pairs = next(same)
            odds = (1 - agree[own]) / agree[own]
            one = odds.sum()
            two = (one**2 - (odds**2).sum()) / 2
            w = len(own)
            counts.append([0.0, pairs + n, pairs * (1 + one) + n * (1 + w), pairs * (1 + one + two) + n * (1 + w + w * (w - 1) / 2)])
        found = allocate(counts, bits - len(groups) + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], groups, found[1])
    return best[1], best[2]


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks of all sets of 1 to t of the bits."""
    return [_signed(sum(1 << b for b in some)) for k in range(1, t + 1) for some in itertools.combinations(bits, k)]


def _split(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, probe, free) once for each of bits + 1 parts of their free bits: the key with the part's value, and the bits that stay free."""
    for batch in batches:
        key, fp, free = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1, 3))
        for mask in np.unique(free):
            at = np.flatnonzero(free == mask)
            own = [b for b in range(BITS) if int(mask) >> b & 1]
            for j in range(bits + 1):
                part = np.uint64(sum(1 << b for b in own[j :: bits + 1]))
                new = (key[at] ^ np.uint64(j + 1) * _MIX[0]) * _MIX[1] + (fp[at] & part) * _MIX[2]
                new = (new ^ new >> np.uint64(29)) * _MIX[0]
                new ^= new >> np.uint64(32)
                probe = batch.column(2).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(fp[at].view(np.int64)), probe, pa.array(np.full(len(at), mask & ~part, np.uint64).view(np.int64))], ["key", "fp", "probe", "free"])


def signatures(distinct: DataFrame, groups: list[list[int]], thresholds: list[int], bits: int = THRESHOLD) -> DataFrame:
    """(key, fp, probe): index rows have probe 0; probe rows carry the key of a value within their part's threshold. Keys of more than HOT rows are split until they are small or few bits are free."""
    parts = []
    for i, (own, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        value = part_value(F.col("fp"), own)
        masks = F.array(*[F.lit(x) for x in [0, *_flips(own, t)]]).cast("array<bigint>")
        free = F.lit(_signed(sum(1 << b for b in range(BITS) if b not in own))).cast("long")
        rows = distinct.select(F.explode(masks).alias("mask"), value.alias("own"), "fp")
        parts.append(rows.select(F.xxhash64(F.lit(i), F.col("own").bitwiseXOR(F.col("mask"))).alias("key"), "fp", (F.col("mask") != 0).cast("int").alias("probe"), free.alias("free")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    out = None
    while True:
        hot = rows.filter(F.bit_count("free") > FREE).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key")
        hot = cut(hot)  # one of HOT rows at most
        small = (rows if hot.isEmpty() else rows.join(hot, "key", "left_anti")).select("key", "fp", "probe")
        out = small if out is None else out.unionByName(small)
        if hot.isEmpty():
            return out
        rows = cut(rows.join(hot, "key", "left_semi").select("key", "fp", "probe", "free").mapInArrow(partial(_split, bits=bits), "key long, fp long, probe int, free long"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _within_reach(fp: np.ndarray, most: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (places) of sorted distinct fingerprints at most so many bits apart, looked up by all sets of bits that vary; None if comparing all pairs is less work."""
    varying = int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
    bits = [b for b in range(BITS) if varying >> b & 1]
    masks = sum(math.comb(len(bits), t) for t in range(1, most + 1))
    if len(fp) < 64 * masks:
        return None
    a, b = [], []
    for t in range(1, most + 1):
        for some in itertools.combinations(bits, t):
            other = fp ^ np.uint64(sum(1 << x for x in some))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            hit = np.flatnonzero(fp[at] == other)
            a.append(hit)
            b.append(at[hit])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch], most: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the verified links among rows with the same (part, value, sub), which come sorted by these and fp."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, fp, probe = rows[:, 0], rows[:, 1].view(np.uint64), rows[:, 2]
        nodes, at = np.unique(fp, return_inverse=True)
        roots = np.arange(len(nodes))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        alive = np.repeat(ends, ends - starts) - np.arange(len(key)) - 1  # rows of the same key that follow
        for s, e in zip(starts[ends - starts > LOOK_UP], ends[ends - starts > LOOK_UP]):
            own = np.unique(at[s:e])
            pairs = _within_reach(nodes[own], most)
            if pairs is not None:
                roots = local_roots(len(nodes), own[pairs[0]], own[pairs[1]], roots)
                alive[s:e] = 0
        row, pending_a, pending_b, held_n, step = np.flatnonzero(alive > 0), [], [], 0, 1
        while len(row):
            other = row + step
            near = (_popcount(fp[row] ^ fp[other]) <= most) & (probe[row] + probe[other] < 2) & (fp[row] != fp[other])
            if near.any():
                pending_a.append(at[row[near]])
                pending_b.append(at[other[near]])
                held_n += int(near.sum())
                if held_n > 1_000_000:
                    roots = local_roots(len(nodes), np.concatenate(pending_a), np.concatenate(pending_b), roots)
                    pending_a, pending_b, held_n = [], [], 0
            step += 1
            row = row[alive[row] >= step]
        if pending_a:
            roots = local_roots(len(nodes), np.concatenate(pending_a), np.concatenate(pending_b), roots)
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[roots[moved]].view(np.int64))], ["a", "b"])

    size = 0
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        held.append(rows)
        size += len(rows)
        if size >= 200_000:
            rows = np.concatenate(held)
            last = int(np.searchsorted((rows[:, 0] != rows[-1, 0]).astype(np.int8)[::-1], 1))  # rows of the last key
            if last < len(rows):
                yield from solve(rows[: len(rows) - last])
                rows = rows[len(rows) - last :]
            held, size = [rows], len(rows)
    if size:
        yield from solve(np.concatenate(held))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component) of every row; component is the smallest doc_id reachable by links. size: words in a shingle; bits: the most that differ."""
    prints = cut(fingerprints(docs, size))
    known = prints.filter(F.col("doc_id").isNotNull())
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups, thresholds = plan(distinct, bits)
    rows = signatures(distinct.select("fp"), groups, thresholds, bits)
    links = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_links, most=bits), "a long, b long")
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select(F.col("doc_id").alias("id"), "a")
    links = links.unionByName(known.join(several, F.col("doc_id") == F.col("id")).select("a", F.col("fp").alias("b")))  # one document, several texts
    parts = connected_components(links, "a", "b")
    reps = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    # The smallest doc_id of a component is the least of its fingerprints' smallest.
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    named = reps.join(least, "root").select(F.col("fp").alias("_fp"), "component")
    joined = prints.join(named, prints["fp"] == named["_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
