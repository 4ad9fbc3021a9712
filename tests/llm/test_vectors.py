"""Centroid clustering against plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from cartospark.llm import centroids


def plain_clusters(rows, k=8, rounds=10):
    """Every distance in full, means by whole division."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [list(q) for _, q in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    find = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, row, strict=True)), j) for j, row in enumerate(c))
    for _ in range(rounds):
        mine = [find(q)[1] for _, q in kept]
        for j in range(len(c)):
            if members := [q for (_, q), m in zip(kept, mine, strict=True) if m == j]:
                c[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = [(i, *find(q)[::-1]) for i, q in kept]
    inertia = {j: sum(d for _, m, d in out if m == j) for j in range(len(c))}
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string")


def odd_rows():
    r = random.Random(5)
    some = [[float(np.float32(r.gauss(0, 1) + 2 * (i % 3))) for _ in range(64)] for i in range(60)]
    rows = list(enumerate(some))
    rows += [(100 + i, some[0]) for i in range(40)] + [(5, some[5]), (None, some[6]), (None, None), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [0.0] * 64), (205, [-0.0] * 64)]
    rows += [(206, [float("nan")] + [0.0] * 63), (207, [float("inf")] + [0.0] * 63), (208, [None] + [0.0] * 63), (209, [-0.0004] * 64)]
    return rows


def test_clusters_equal_plain_arithmetic(spark):
    rows = odd_rows()
    got = sorted(map(tuple, centroids.cluster(vectors(spark, rows)).collect()), key=repr)
    assert got == sorted(plain_clusters(rows), key=repr) and len({g[1] for g in got}) > 3


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = odd_rows()[:n]
    out = centroids.cluster(vectors(spark, rows))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(plain_clusters(rows))


def test_search_equals_full_distances_with_ties():
    r = np.random.default_rng(1)
    x, c = r.integers(-3, 4, (500, 64)), r.integers(-3, 4, (20, 64))
    c[7], c[15] = c[3], x[10]
    x[:50] = c[3]
    label, best = centroids.nearest(x, c)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (label == full.argmin(1)).all() and (best == full.min(1)).all()


def test_huge_components_stop_at_the_limit(spark):
    out = centroids.quantised(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)])).collect()
    assert {r["vec_id"]: set(r["q"]) for r in out} == {1: {centroids.LIMIT}, 2: {-centroids.LIMIT}}
    ends = np.array([[centroids.LIMIT] * 64, [-centroids.LIMIT] * 64])
    assert centroids.nearest(ends[:1], ends[1:])[1].tolist() == [64 * (2 * centroids.LIMIT) ** 2]
