"""Vector codes against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessaline.llm import vector_codes


def plain(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dim = max(8, -(-max(len(v) for _, v, _ in kept) // 8) * 8)
    w = dim // 8
    ints = [(i, [math.floor(4096 * x) for x in v] + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    least = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[ints[k][1][p * w : p * w + w] for k in least] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in ints:
                groups[near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in ints:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        total[lab] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, lab))
    top = 2**63 - 1
    return sorted(((i, c, min(e, top), min(total[lab], top), sha) for i, c, e, lab in out), key=repr)


def coded(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, part int").repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=repr)


def vectors(seed, n, dim=64, spread=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) * spread).astype(np.float32)
    return [(int(i), [float(v) for v in r], int(i) % 4 if i % 5 else None) for i, r in enumerate(x)]


def test_codes_equal_plain_integers(spark):
    rows = vectors(1, 300)
    assert coded(spark, rows) == plain(rows)
    ties = [(i, [float(i % 3)] * 16, i % 2) for i in range(60)]  # equal entries, entries without parts
    assert coded(spark, ties) == plain(ties)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [*vectors(2, 40, 10), (None, [1.0] * 10, None), (3, [0.5] * 7, 1), (3, [0.25] * 10, 1), (3, [0.25] * 10, 1), (50, None, 1), (51, [], 2), (52, [None, 1.0], 2), (53, [nan], 2), (54, [inf, 0.0], 2), (55, [-inf], None), (-9, [-0.00001] * 10, 9)]
    assert coded(spark, rows) == plain(rows)
    few = [(1, [1.0, 2.0], None), (2, [-1.0, 0.0], None)]
    assert coded(spark, few) == plain(few)
    assert coded(spark, [(1, [], 1), (2, [], 1)]) == plain([(1, [], 1), (2, [], 1)])
    assert coded(spark, []) == [] == coded(spark, [(1, None, 1), (2, [nan], 1)])


def test_components_beyond_64_bits(spark):
    rows = [(i, [v * 1e9 for v in x], lab) for i, x, lab in vectors(3, 40, 16)]
    assert coded(spark, rows, "double") == plain(rows)


@pytest.mark.parametrize("bits", [0, 1, 2, 4])
def test_bounds_hold_and_filtering_changes_nothing(bits):
    rng = np.random.default_rng(bits)
    entries, x = rng.integers(-500, 500, (16, 8)), rng.integers(-900, 900, (700, 8))
    entries[5] = entries[9]
    approximation = vector_codes.cells(entries, bits)
    least, most = vector_codes.bounds(x, *approximation)
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    index, distance = vector_codes.nearest(x, entries, approximation)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if bits >= 2:
        assert (least <= most.min(axis=1)[:, None]).sum() < 0.7 * exact.size  # refined


def test_order_of_rows_does_not_matter(spark):
    rows = vectors(4, 100, 8)
    random.Random(1).shuffle(rows)
    assert coded(spark, rows) == plain(rows)
