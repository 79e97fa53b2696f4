"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one row from the start, under a number of their own (rep). In each pass every vector gets a
string of signs of random projections; vectors are ordered by these strings
lexicographically (a range partition and a sort) and compared with the next WINDOW
neighbours, also across partition borders. Verified pairs are united over all passes. At
cosine 0.95 a sign differs with probability 0.101.

A window bounds the candidates, so a dense group does not see all its links there. Runs of
more than WINDOW vectors with the same first signs (the prefix), which windows do not cover, are
therefore compared in full, in blocks of BLOCK vectors by BLOCK, unless the windows have
joined all their vectors already. A pair is then missed only if it differs in the prefix of every
pass, whatever the density of the vectors. The prefix has PREFIX signs or more, so that with spread vectors a run
is no longer than a window, and the number of passes follows from it and from MISS: at
cosine 0.95 a pair is missed with probability (1 - 0.899^prefix)^passes <= MISS over the draw of the
projections (12 signs and 22 passes up to 262,144 vectors, 24 signs and 86 passes for 10^9).

The passes are only asked for the components; an exact check follows, which counts every link
of a component in double precision and emits one number for each vector, never the pairs. Vectors within half of
the link's angle of the component's first vector (the core) are all linked with one another and are
counted without a comparison; only the others are compared, in blocks, with each other and with
the core. That work grows with the vectors outside the core times all of the component's, spread over tasks.

Defined results: vectors that are null, empty, zero or that hold null or non-finite
components link with nothing; vectors of different lengths do not link; equal vectors link
with each other; rows that share vec_id and vector are one vector and get a row each; rows that share a vec_id
and differ in the vector are vectors of their own, which the id alone does not link, each with its own links and
the smallest vec_id of its own component; a null
vec_id links with nothing; ties in a sort order are broken by the vector's number; vectors of any length
are compared whole; other columns are ignored, whatever their names; an empty table works.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import cut
from tessaline.llm.components import connected_components, local_roots

WINDOW, SIGNS, BLOCK, SEED = 64, 63, 2048, 20_241
PREFIX = 12  # signs of a run, at least
MISS = 0.001  # chance that the passes miss a pair at the least cosine
MIN_COSINE = 0.95


def schedule(vectors: int, least: float, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """(signs of the prefix, passes) for so many vectors."""
    prefix = min(SIGNS, max(PREFIX, math.ceil(math.log2(max(vectors, 1) / window))))
    share = (1 - math.acos(least) / math.pi) ** prefix
    return prefix, math.ceil(math.log(miss) / math.log1p(-share))


def _usable(vector: str):
    """Whether a vector can link: no null, NaN or infinity, and not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def projections(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dim]).standard_normal((dim, SIGNS))


def _prefixes(batches: Iterator[pa.RecordBatch], passes: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The first signs of _keys' strings, without the vectors."""
    names = ["dim", "pass", "key", "rep"]
    for batch in _keys(batches, passes):
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(batch.column(2).to_numpy() >> (SIGNS - prefix)), batch.column(3)], names)


def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    cache: dict[tuple[int, int], np.ndarray] = {}
    weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        dims = np.array(batch.column(1).value_lengths())
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            unit = _unit(rows.column(1))
            for p in range(passes):
                if (dim, p) not in cache:
                    cache[dim, p] = projections(int(dim), p)
                keys = (unit @ cache[dim, p] > 0) @ weights
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(keys), rows.column(0), rows.column(1)], ["dim", "pass", "key", "rep", "vector"])


def _forest(reps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(reps, return_inverse=True)
    roots = local_roots(len(nodes), at[a], at[b])
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


def _near(x: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows at most window apart with a cosine of at least least."""
    found_a, found_b = [], []
    step = 512
    for start in range(0, len(x), step):
        here, there = x[start : start + step], x[start : start + step + window]
        i, j = np.nonzero(here @ there.T >= least)
        ok = (j > i) & (j - i <= window)
        found_a.append(i[ok] + start)
        found_b.append(j[ok] + start)
    return np.concatenate(found_a or [np.empty(0, int)]), np.concatenate(found_b or [np.empty(0, int)])


SCAN = "a long, b long, border int, side int, dim int, pass int, rep long, vector array<double>"


def _scan(batches: Iterator[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links within windows of one sorted partition, and its first and last rows for the borders."""
    partition = TaskContext.get().partitionId()

    def out(a, b, border=None, side=None, tag=None, reps=None, vectors=None):
        n = len(a) if border is None else len(reps)
        none = lambda t: pa.nulls(n, t)
        if border is None:
            columns = [pa.array(a), pa.array(b), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.float64()))]
        else:
            columns = [none(pa.int64()), none(pa.int64()), pa.array(np.full(n, border, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, tag[0], np.int32)), pa.array(np.full(n, tag[1], np.int32)), pa.array(reps), pa.array(list(vectors), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "border", "side", "dim", "pass", "rep", "vector"])

    tag, reps, vectors, first = None, np.empty(0, np.int64), None, True
    for batch in batches:
        dims, passes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (passes[1:] != passes[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(dims)]):
            now = (int(dims[start]), int(passes[start])) if end > start else tag
            if end == start:
                continue
            new_reps, new = batch.column(3).to_numpy()[start:end], _unit(batch.column(4).slice(start, end - start))
            if now != tag:
                tag, reps, vectors = now, new_reps, new
            else:
                reps, vectors = np.concatenate([reps, new_reps]), np.concatenate([vectors, new])
            if first:
                yield out(None, None, partition - 1, 1, tag, reps[:window], vectors[:window])
                first = False
            a, b = _forest(reps, *_near(vectors, window, least))
            if len(a):
                yield out(a, b)
            reps, vectors = reps[-window:], vectors[-window:]
    if tag is not None:
        yield out(None, None, partition, 0, tag, reps, vectors)


def _across(group: pa.Table, least: float) -> pa.Table:
    """Links between the last rows of one partition and the first of the next; at most twice WINDOW rows."""
    a, b = [], []
    side, dim, number, reps = (group.column(c).to_numpy() for c in ("side", "dim", "pass", "rep"))
    vectors = group.column("vector").to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(left) and len(right) and dim[left[0]] == dim[right[0]] and number[left[0]] == number[right[0]]:
        i, j = np.nonzero(np.array([vectors[k] for k in left]) @ np.array([vectors[k] for k in right]).T >= least)
        a, b = reps[left[i]], reps[right[j]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dense(group: pa.Table, least: float) -> pa.Table:
    """Links between vectors of different roots in one pair of blocks of a run."""
    right, reps, roots = (group.column(c).to_numpy() for c in ("right", "rep", "root"))
    x = _unit(group.column("vector").combine_chunks())
    left_i = np.flatnonzero(right == 0)
    right_i = np.flatnonzero(right == 1) if right.any() or group.column("i")[0] != group.column("j")[0] else left_i
    i, j = np.nonzero((x[left_i] @ x[right_i].T >= least) & (roots[left_i][:, None] != roots[right_i]))
    a, b = _forest(reps, left_i[i], right_i[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def dense_links(copies: DataFrame, parts: DataFrame, least: float, passes: int, window: int, prefix: int) -> DataFrame:
    """(a, b): links between components in runs of more than window vectors that share a prefix."""
    run = ["dim", "pass", "key"]
    keyed = copies.select("rep", "vector").mapInArrow(partial(_prefixes, passes=passes, prefix=prefix), "dim int, pass int, key long, rep long")
    dense = cut(keyed.groupBy(*run).agg(F.count("*").alias("n")).filter(F.col("n") > window))
    rows = keyed.join(dense, run).join(parts, F.col("rep") == F.col("node"), "left").select(*run, "n", "rep", F.coalesce("component", "rep").alias("root"))
    rows = cut(rows)
    open_ = rows.groupBy(*run).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(*run)
    rows = rows.join(open_, run).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(copies.select("rep", "vector"), "rep")
    rows = rows.select(*run, "rep", "root", "vector", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    rows = rows.select(*run, F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("k") < F.col("own")).cast("int").alias("right"), "rep", "root", "vector")

    def compare(group: pa.Table) -> pa.Table:
        return _dense(group, least)

    return rows.groupBy(*run, "i", "j").applyInArrow(compare, "a long, b long")


def _count(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Weighted links of each vector in one pair of blocks; rows come sorted by (root, core, i, j, right)."""

    def solve(rows: list) -> pa.RecordBatch:
        right = np.array([r[1] for r in rows])
        reps = np.array([r[2] for r in rows])
        copies = np.array([r[3] for r in rows], dtype=np.int64)
        x = _unit(pa.array([r[4] for r in rows], pa.list_(pa.float64())))
        same = not rows[0][0][1] and rows[0][0][2] == rows[0][0][3]
        left_i = np.flatnonzero(right == 0)
        right_i = left_i if same else np.flatnonzero(right == 1)
        near = x[left_i] @ x[right_i].T >= least
        if same:
            np.fill_diagonal(near, False)
            return pa.RecordBatch.from_arrays([pa.array(reps[left_i]), pa.array(near @ copies[right_i])], ["rep", "linked"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([reps[left_i], reps[right_i]])), pa.array(np.concatenate([near @ copies[right_i], copies[left_i] @ near]))], ["rep", "linked"])

    held: list = []
    for batch in batches:
        root, core, i, j, right, reps, copies, vectors = (c.to_pylist() for c in batch.columns)
        for row in zip(zip(root, core, i, j), right, reps, copies, vectors):
            if held and held[-1][0] != row[0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _core(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Whether each vector lies within half the link's angle of its component's first vector; a little less, so that rounding never makes a link."""
    near = math.cos(math.acos(least) / 2) + 1e-9
    for batch in batches:
        cosine = np.einsum("ij,ij->i", _unit(batch.column(3)), _unit(batch.column(4))) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cosine >= near)], ["root", "rep", "copies", "core"])


def count_links(copies: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(rep, linked): the links of each vector of a component, weighted by copies, without those to its own copies."""
    members = copies.join(parts, F.col("rep") == F.col("node")).select("rep", "copies", F.col("component").alias("root"))
    first = copies.select(F.col("rep").alias("root"), F.col("vector").alias("first"))
    both = members.join(copies.select("rep", "vector"), "rep").join(first, "root").select("root", "rep", "copies", "vector", "first")  # of equal length, as only such vectors link
    marked = cut(both.mapInArrow(partial(_by_length, then=partial(_core, least=least)), "root long, rep long, copies long, core boolean"))
    sizes = marked.groupBy("root").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("weight"))
    marked = marked.join(sizes, "root")
    linked = marked.filter("core").select("rep", (F.col("weight") - F.col("copies")).alias("linked"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rest = marked.filter("n_rest > 0").withColumn("own", F.pmod(F.xxhash64("rep"), F.greatest(F.when(F.col("core"), blocks("n_core")).otherwise(blocks("n_rest")), F.lit(1))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meets = lambda core, k, i, j, right: F.struct(F.lit(core).alias("with_core"), i.alias("i"), j.alias("j"), right.cast("int").alias("right"))
    own = F.col("own")
    among = F.transform(upto(blocks("n_rest")), lambda k: meets(False, k, F.least(own, k), F.greatest(own, k), k < own))
    of_rest = F.transform(upto(blocks("n_core")), lambda k: meets(True, k, own, k, F.lit(0)))
    of_core = F.transform(upto(blocks("n_rest")), lambda k: meets(True, k, k, own, F.lit(1)))
    pairs = rest.select("root", "rep", "copies", F.explode(F.when(F.col("core"), of_core).otherwise(F.concat(among, of_rest))).alias("p")).select("root", "p.*", "rep", "copies")
    pairs = pairs.join(copies.select("rep", "vector"), "rep").select("root", "with_core", "i", "j", "right", "rep", "copies", "vector")
    key = ["root", "with_core", "i", "j"]
    compared = pairs.repartition(*key).sortWithinPartitions(*key, "right", "rep").mapInArrow(partial(_count, least=least), "rep long, linked long")
    return linked.unionByName(compared).groupBy("rep").agg(F.sum("linked").alias("linked"))


def _by_length(batches: Iterator[pa.RecordBatch], then) -> Iterator[pa.RecordBatch]:
    """Rows of equal vector length at a time."""
    for batch in batches:
        sizes = np.array(batch.column(3).value_lengths())
        for size in np.unique(sizes):
            yield from then(iter([batch.filter(pa.array(sizes == size))]))


def near_duplicates(rows: DataFrame, least: float = MIN_COSINE, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    own = own.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))  # no -0.0
    ok = F.col("vec_id").isNotNull() & _usable("vector")
    usable = own.filter(ok)
    copies = usable.distinct().groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    copies = cut(copies.withColumn("rep", F.monotonically_increasing_id()))
    prefix, passes = schedule(copies.count(), least, window, miss)

    keyed = copies.select("rep", "vector").mapInArrow(partial(_keys, passes=passes), f"dim int, pass int, key long, rep long, vector array<{kind}>")
    order = ["dim", "pass", "key", "rep"]
    scanned = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_scan, least=least, window=window), SCAN)
    scanned = cut(scanned)
    borders = scanned.filter(F.col("border").isNotNull()).select("border", "side", "dim", "pass", "rep", "vector")

    def compare(group: pa.Table) -> pa.Table:
        return _across(group, least)

    across = borders.groupBy("border").applyInArrow(compare, "a long, b long")
    links = scanned.filter(F.col("a").isNotNull()).select("a", "b").unionByName(across)
    parts = cut(connected_components(links, "a", "b"))
    more = cut(dense_links(copies, parts, least, passes, window, prefix))
    if not more.isEmpty():
        parts = cut(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b"))
    counted = count_links(copies, parts, least)

    ids = copies.select("rep", "least_id").join(parts, F.col("rep") == F.col("node"))
    least_ids = ids.groupBy(F.col("component").alias("_component")).agg(F.min("least_id").alias("_least"))
    parts = parts.join(least_ids, F.col("component") == F.col("_component")).select("node", F.col("_least").alias("component"))
    known = copies.join(parts, copies["rep"] == parts["node"], "left").select("rep", "copies", F.coalesce("component", "least_id").alias("component_id"), copies["vector"])
    known = known.join(counted.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left")
    known = known.select(F.col("vector").alias("_vector"), F.xxhash64("vector").alias("_h"), "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    mine = own.withColumn("ok", ok).withColumn("h", F.when(F.col("ok"), F.xxhash64("vector")))
    joined = mine.join(known, (mine["h"] == known["_h"]) & (mine["vector"] == known["_vector"]), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
