"""Bridges and cut nodes by joins against removing each edge and node."""

import random

import pytest

from cartospark.operators import analysis, forest


def parts(nodes, pairs):
    label = {i: i for i in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return len({find(i) for i in nodes})


def plain(pairs):
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    nodes = {i for p in pairs for i in p}
    n = parts(nodes, pairs)
    out = {("bridge", a, b, None) for a, b in pairs if parts(nodes, pairs - {(a, b)}) > n}
    for i in nodes:
        more = parts(nodes - {i}, {p for p in pairs if i not in p}) - n
        if more > 0:
            out.add(("articulation", i, None, more))
    return out


def graphs():
    r = random.Random(3)
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(200, 201 + i) for i in range(30)]
    ring = [(300 + i, 300 + (i + 1) % 12) for i in range(12)]
    chained = [(400 + 3 * i + a, 400 + 3 * i + b) for i in range(6) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3))]
    wild = [(500 + r.randrange(50), 500 + r.randrange(50)) for _ in range(70)]
    return [*path, *star, *ring, *chained, *wild, (7, 7), (2, 1), (900, 901)]


def found(spark, pairs, kind="long"):
    df = spark.createDataFrame(pairs, f"src {kind}, dst {kind}")
    return {tuple(r) for r in analysis.weak_points(df).collect()}


@pytest.mark.parametrize("one_task", [0, 20])
def test_weak_points_of_any_size(spark, monkeypatch, one_task):
    monkeypatch.setattr(analysis, "ONE_TASK", one_task)
    monkeypatch.setattr(forest, "BLOCK", 4)
    assert found(spark, graphs()) == plain(graphs())


def test_order_of_a_forest(spark, monkeypatch):
    """Parents, preorder and sizes fit together."""
    pairs = sorted({(min(p), max(p)) for p in graphs() if p[0] != p[1]})
    simple = spark.createDataFrame(pairs, "a long, b long")
    labels = analysis.network.components(simple.selectExpr("a as src", "b as dst"))
    tree = forest.spanning_forest(simple)
    rows = {r["id"]: r for r in forest.rooted(tree, labels).collect()}
    nodes = {i for p in pairs for i in p}
    assert set(rows) == nodes and tree.count() == len(nodes) - parts(nodes, set(pairs)) and parts(nodes, {tuple(r) for r in tree.collect()}) == parts(nodes, set(pairs))
    assert sorted(r["pre"] for r in rows.values()) == list(range(len(nodes)))
    for r in rows.values():
        below = [x for x in rows.values() if r["pre"] <= x["pre"] < r["pre"] + r["size"]]
        assert len(below) == r["size"] and all(x["parent"] in {y["id"] for y in below} for x in below if x["id"] != r["id"])
        assert r["parent"] is None if r["id"] == r["component"] else (min(r["id"], r["parent"]), max(r["id"], r["parent"])) in set(pairs)


def test_text_ids_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(analysis, "ONE_TASK", 0)
    assert found(spark, [("a", "b"), ("b", "c")], "string") == {("bridge", "a", "b", None), ("bridge", "b", "c", None), ("articulation", "b", None, 1)}
    assert found(spark, []) == set()
