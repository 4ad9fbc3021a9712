"""Cross-polytope near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from cartospark.llm import embedding_dedup


def plain_duplicates(rows, least=0.93):
    """All pairs of a label in double precision."""
    n = len(rows)
    sound = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((root[i], root[j]))
                    root = [x if r == y else r for r in root]
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[root[i]] = min(low.get(root[i], v), v)
    return sorted([(rows[i][0], links[i], low.get(root[i]) if sound[i] else rows[i][0], rows[i][0] is not None and rows[i][0] == (low.get(root[i]) if sound[i] else rows[i][0])) for i in range(n)], key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, lab, 1, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node int, key string")
    out = embedding_dedup.near_duplicates(df, **more)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


def around(r, center, cos, n):
    """Vectors at a cosine of a centre."""
    out = []
    for _ in range(n):
        d = r.normal(size=len(center))
        d -= d @ center * center
        out.append((cos * center + np.sqrt(1 - cos * cos) * d / np.linalg.norm(d)).tolist())
    return out


def groups(dim=64, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).tolist(), i % 3) for i in range(90)]
    for g, (cos, n) in enumerate([(0.999, 60), (0.97, 40), (0.95, 30), (0.932, 12)]):
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        rows += [(1000 * (g + 1) + k, v, 1) for k, v in enumerate([c.tolist(), *around(r, c, cos, n)])]
    return rows


ODD = [(5001, None, 1), (5002, [], 1), (5003, [0.0] * 64, 1), (5004, [float("nan")] * 64, 1), (5005, [float("inf")] + [1.0] * 63, 1), (5006, [None] + [1.0] * 63, 1), (None, [1.0] * 64, 1), (5007, [1.0] * 64, 1), (5008, [1.0] * 64, None), (5009, [1.0] * 64, None)]
ODD += [(5010, [2.0] * 64, 1), (5010, [2.0] * 64, 1), (5011, [1.0] * 3, 1), (5012, [1.0, 1.0, 1.1], 1), (5013, [1.0], 2), (5014, [2.0], 2), (5015, [-2.0], 2), (5016, [1e-44] * 64, 1), (5017, [3e38] * 64, 1), (5018, [-1.0] * 64, 1), (None, None, None), (None, [1.0] * 64, 1)]


def test_links_equal_all_pairs(spark):
    rows = groups() + ODD
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == plain_duplicates(rows)


def test_small_blocks_and_more_functions(spark, monkeypatch):
    """Hot buckets in many blocks, balls apart from the rest, two functions a table."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 1)
    rows = groups(seed=4) + [(7000 + i, [1.0] * 64, 1) for i in range(30)]
    assert run(spark, rows) == plain_duplicates(rows)


@pytest.mark.parametrize("rows", [[], ODD[:6], [(1, [1.0, 0.0], 1)]])
def test_few_vectors(spark, rows):
    assert run(spark, rows) == plain_duplicates(rows)


def test_tables_find_what_they_promise():
    r = np.random.default_rng(9)
    for functions in (1, 2):
        tables = embedding_dedup.tables_for(64, functions, 0.93)
        a = r.normal(size=(3000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = np.array([around(r, x, 0.93, 1)[0] for x in a])
        x, y = embedding_dedup.meets(embedding_dedup.signature(a, functions, tables), embedding_dedup.signature(b, functions, tables))
        assert (x | y).any(1).mean() >= 0.99 and tables < embedding_dedup.MAX_TABLES
    assert np.allclose(embedding_dedup.hadamard(np.eye(8)) @ embedding_dedup.hadamard(np.eye(8)).T, np.eye(8))
