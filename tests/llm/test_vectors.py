"""Vector operators against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from dwellspan.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, cluster int, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, "y") for i, v, label in rows], SCHEMA).repartition(3)


def plain_clusters(rows, size, k, rounds):
    kept = [(i, [min(max(math.floor(1024 * x), -(2**63)), 2**63 - 1) for x in v]) for i, v, _ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [q for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        for j, group in own.items():
            centres[j] = [sum(x) // len(group) for x in zip(*group)]
    top = 2**63 - 1
    out = [(i, *near(q)) for i, q in kept]
    each = {}
    for _, d, j in out:
        each[j] = each.get(j, 0) + min(d, top)
    return sorted(repr((i, j, min(d, top), min(each[j], top), min(sum(each.values()), top), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())) for i, d, j in out)


def odd_rows(size, n, seed, wide=1.0):
    dice = random.Random(seed)
    rows = [(i, [dice.gauss(0, 1) * (wide if i % 5 == 0 else 1) for _ in range(size)], dice.randrange(3)) for i in range(n)]
    rows += [(rows[3][0], rows[4][1], 1)] + [(100 + i, rows[2][1], 2) for i in range(40)]  # an id twice, a vector 41 times
    rows += [(200, None, 1), (201, [], 1), (202, [None] * size, 0), (203, [math.nan] * size, 0), (204, [math.inf] + [0.0] * (size - 1), 1), (205, [0.5] * (size - 1), 1), (None, [0.25] * size, 2), (206, [0.0] * size, None)]
    return rows


@pytest.mark.parametrize("wide", [1.0, 1e7, 1e30])
def test_clusters(spark, wide):
    rows = odd_rows(12, 60, 5, wide)
    got = centroids.clusters(table(spark, rows), size=12, k=5, rounds=4).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_clusters(rows, 12, 5, 4)


def test_few_vectors(spark):
    assert centroids.clusters(table(spark, []), size=2).count() == 0
    got = centroids.clusters(table(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], None)]), size=2).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(eval(x)[:3] for x in plain_clusters([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], None)], 2, 8, 10))


def test_abandoning():
    dice = np.random.Generator(np.random.PCG64(1))
    x, c = dice.integers(-3, 4, (500, 24)), dice.integers(-3, 4, (9, 24))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    cluster, distance = centroids.nearest(x, c, dice.permutation(24))
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def plain_negatives(rows, every=50):
    top = 2**63 - 1
    kept = [(i, label, [min(max(math.floor(256 * x), -top - 1), top) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(q, p)), -top), top), j is None, j or 0, j, other) for b, (j, other, p) in enumerate(kept) if b != a]
        for s, _, _, positive, _ in sorted(x for x in scored if x[4] == label)[:5]:
            fits = sorted(x for x in scored if x[4] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, positive, n + 1, x[3], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("wide, block", [(1.0, 1 << 16), (1.0, 16), (1e5, 16), (1e9, 1 << 16)])
def test_negatives(spark, monkeypatch, wide, block):
    monkeypatch.setattr(negatives, "CELL", 16)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", 4)
    rows = odd_rows(6, 90, 8, wide) + [(0, [0.5] * 6, 1), (0, [0.5] * 6, 1), (10, [0.1, 0.2], 0), (20, [], 2), (30, [0.0] * 6, 1)]
    got = negatives.hard_negatives(table(spark, rows), every=10).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_negatives(rows, 10)


def test_no_anchors(spark):
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    assert negatives.hard_negatives(table(spark, [(1, [0.5], 1), (2, [0.5], 2)])).count() == 0
    assert negatives.hard_negatives(table(spark, [(50, [0.5], 1)])).count() == 0


def test_dual_trees():
    """Products of far clusters are never scored, and what is left is exact."""
    dice = np.random.Generator(np.random.PCG64(3))
    centres = dice.integers(-400, 400, (12, 16))
    x = (centres[dice.integers(0, 12, 3000)] + dice.integers(-9, 10, (3000, 16))).astype(np.int64)

    def tree(rows, leaf):
        order, ends = negatives._split(x[rows], leaf)
        rows = rows[order]
        return {"x": x[rows], "ends": ends, "ids": rows.astype(np.int64), "none": np.zeros(len(rows), bool), "keys": rows}

    a, b = tree(np.arange(0, 3000, 10), 8), tree(np.arange(3000), 32)
    scored = []

    def hits(rows, s, others, floor):
        scored.append(s.size)
        r, c = np.nonzero(s >= floor)
        yield rows[r], r, c

    best = negatives._visit(a, b, np.full(300, -negatives.LONGEST - 1), np.full(300, negatives.LONGEST), 5, hits)
    full = a["x"] @ b["x"].T
    for r in range(300):
        order = np.lexsort((b["ids"], -full[r]))[:5]
        assert best.id[best.slot == r].tolist() == b["ids"][order].tolist()
    assert sum(scored) < full.size // 2
