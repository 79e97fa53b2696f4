"""SimHash, embeddings and components against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import xxhash

from tessaline.llm import embedding_dedup, simhash
from tessaline.llm.components import connected_components


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in least_reachable(nodes | {x for p in links for x in p}, links).items() if k in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, size=3, bits=2):
    """The smallest reachable id of each id; rows with one id are one node."""
    prints = [(i, plain_fingerprint(t, size)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= bits]
    return least_reachable([i for i, _ in prints], links)


def check_simhash(spark, rows, size=3, bits=2):
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, component int")
    got = [(r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs, size, bits).collect()]
    want = plain_groups(rows, size, bits)
    assert sorted(got, key=repr) == sorted(((i, plain_fingerprint(t, size), want.get(i)) for i, t in rows), key=repr)


def near_copies(n=300):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 300))] for _ in range(12)]
    rows = [(-1, None), (-2, ""), (-3, "  \n"), (-4, "one"), (-5, "One two"), (-6, "one TWO three"), (-7, "É é"), (None, "one"), (-8, "long " * 60_000)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return [*rows, rows[3], rows[-1]]


def test_simhash(spark):
    check_simhash(spark, near_copies())


def test_simhash_of_repeated_ids(spark):
    a, b = ("some words about one thing " * 3, "others on something else altogether now " * 2)
    check_simhash(spark, [(1, a), (5, a), (5, b), (9, b), (7, "neither of them"), (5, a)])


def test_simhash_with_other_parameters(spark):
    check_simhash(spark, near_copies(200), 5, 6)


def test_simhash_hot_values(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    check_simhash(spark, near_copies(150))


def test_simhash_looks_up_large_groups(monkeypatch):
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 14, 9000).astype(np.uint64) << np.uint64(7))
    a, b = simhash._within_reach(fp)
    near = np.bitwise_count(fp[:, None] ^ fp) <= 2
    want = np.zeros_like(near)
    want[a, b] = True
    np.fill_diagonal(near, False)
    assert (want == near).all()


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_thresholds_keep_every_pair():
    cost, thresholds = simhash.allocate([[0, 5, 50, 90], [0, 1, 2, 9], [0, 7, 70, 99]], 0)
    assert sum(thresholds) == 0 and cost == min(sum(c[t + 1] for c, t in zip([[0, 5, 50, 90], [0, 1, 2, 9], [0, 7, 70, 99]], ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=3) if sum(ts) == 0)


def plain_embeddings(rows):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    want = least_reachable([i for i, _ in rows if i is not None], links)
    degree = {i: sum(i in p for p in links) for i in want}
    return sorted(((i, degree.get(i, 0), want.get(i)) for i, _ in rows), key=repr)


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 25)):
            rows.append((centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist())
    rows = [(i, v) for i, v in enumerate(rows)]
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None, *[1.0] * 15]), (2005, [float("inf")] * 16), (None, same), (2006, [1.0, 0.0]), (2007, [2.0, -0.0]), (2008, [2.0, 0.0])]
    return rows


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == plain_embeddings(rows)


def test_embeddings_with_a_core(spark, monkeypatch):
    """Tight groups, whose links are counted without a comparison, with looser members around them."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(4):
        centre = rng.standard_normal(32)
        rows += [(centre + rng.standard_normal(32) * s).tolist() for s in rng.choice([0.02, 0.08, 0.15, 0.22], 60)]
    rows = [(i, v) for i, v in enumerate(rows)] + [(1000 + i, rows[3]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == plain_embeddings(rows)


def test_schedule_of_passes():
    assert embedding_dedup.schedule(2000, 0.95) == (12, 22) and embedding_dedup.schedule(10**9, 0.95) == (24, 86)
    for n in (1, 10**4, 10**7, 10**12):
        prefix, passes = embedding_dedup.schedule(n, 0.95)
        assert (1 - 0.89891**prefix) ** passes < 0.0011 and n / 2**prefix <= 64


def test_recall_of_the_passes_alone():
    """Pairs at a cosine just above 0.95 among spread vectors: the share that shares a prefix in some pass."""
    rng = np.random.default_rng(7)
    a = rng.standard_normal((20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((20_000, 64))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = 0.9501 * a + (1 - 0.9501**2) ** 0.5 * b / np.linalg.norm(b, axis=1)[:, None]
    for prefix, passes in ((12, 22), (18, 42)):
        met = np.zeros(len(a), bool)
        for p in range(passes):
            own = embedding_dedup.projections(64, p)[:, :prefix]
            met |= ((a @ own > 0) == (b @ own > 0)).all(axis=1)
        assert met.mean() > 0.995


def test_embeddings_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(twice).collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_embeddings_of_a_dense_group(spark):
    """A hot group at mutual cosine 0.8, in which pairs at 0.95 are more than a window apart in most passes; a narrow window stands for a larger group."""
    rng = np.random.default_rng(8)
    centre = np.eye(64)[0]
    own = rng.standard_normal((3000, 64))
    own[:, 0] = 0
    own /= np.linalg.norm(own, axis=1)[:, None]
    x = 0.8**0.5 * centre + 0.2**0.5 * own
    for k in range(600):  # partners just above 0.95
        away = own[k + 2000] - (own[k + 2000] @ x[k]) * x[k]
        x[k + 1000] = 0.9505 * x[k] + (1 - 0.9505**2) ** 0.5 * away / np.linalg.norm(away)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = list(zip(*(e.tolist() for e in np.nonzero(np.triu(near)))))
    assert len(links) >= 600
    want = least_reachable(range(3000), links)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, window=2).collect()}
    missed = sum(near.sum(axis=1).tolist()) - sum(n for n, _ in got.values())
    assert missed <= 2, f"{missed // 2} of {len(links)} links"
    assert sum(got[i][1] != want[i] for i in want) <= 1


def test_embeddings_of_shared_ids(spark):
    """Rows that share an id and differ in the vector are vectors of their own; equal rows are one."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 8))
    rows = [(int(rng.integers(0, 40)), (centres[rng.integers(0, 12)] + 0.08 * rng.standard_normal(8)).astype(np.float32).tolist()) for _ in range(150)]
    rows += rows[:30] + [(i % 40, rows[3][1]) for i in range(25)]
    probe = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0])]
    for case in (probe, rows):
        nodes = sorted({(i, tuple(v)) for i, v in case})
        x = np.array([v for _, v in nodes], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.95
        root = least_reachable(range(len(nodes)), [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if a < b])  # nodes are sorted by id
        want = {n: (int(near[k].sum()) - 1, nodes[root[k]][0]) for k, n in enumerate(nodes)}
        df = spark.createDataFrame(case, "vec_id long, embedding array<float>").repartition(3)
        assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == sorted((i, *want[i, tuple(v)]) for i, v in case)


def test_links_of_a_whole_table_by_brute_force(spark):
    """Every row of a given table, ids divisible by 20 against all: the links that brute force finds, and none else."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.select("vec_id", "embedding").toPandas()
    x = np.array(data.embedding.tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.flatnonzero(data.vec_id.to_numpy() % 20 == 0)
    want = dict(zip(data.vec_id.to_numpy()[asked].tolist(), ((x[asked] @ x.T >= 0.95).sum(axis=1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(rows).filter("vec_id % 20 = 0").collect()}
    assert got == want


def test_hot_values_are_split_until_they_are_small(spark, monkeypatch):
    """Fingerprints that agree in most bits: no key keeps more than HOT index rows while enough bits are free, and no pair is lost."""
    monkeypatch.setattr(simhash, "HOT", 40)
    rng = np.random.default_rng(12)
    low = np.unique(rng.integers(0, 1 << 16, 600)).astype(np.uint64)
    fp = (low << np.uint64(3)) | np.uint64(1 << 60)
    distinct = spark.createDataFrame([(int(f) - (1 << 64) if f >= 1 << 63 else int(f),) for f in fp], "fp long").repartition(3)
    groups = [list(range(32, 64)), list(range(32))]
    rows = simhash.signatures(distinct, groups, [0, -1], 2)
    sizes = [r["count"] for r in rows.groupBy("key").count().collect()]
    assert max(sizes) <= 64 and len(sizes) > 20  # 32 bits are equal; what is left varies in 16
    keys = {}
    for r in rows.collect():
        keys.setdefault(r.key, set()).add(r.fp)
    met = {frozenset(p) for k in keys.values() for p in itertools.combinations(k, 2)}
    near = [(int(a), int(b)) for a, b in itertools.combinations(fp.tolist(), 2) if (a ^ b).bit_count() <= 2]
    assert near and all(frozenset(p) in met for p in near)
