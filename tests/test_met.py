"""Pairs of nodes in a graph that is too large to pack: searched from both ends, not by whole trees."""

import random

import pytest

from cartospark.operators import routing

EDGE = "src long, dst long, way_id long, pos int, highway string, name string, distance_m double, time_s double"


@pytest.fixture
def graph(spark, monkeypatch):
    """A random graph with many equal costs, as asked of tables; whole trees of it must not be asked for."""
    draw = random.Random(1)
    rows = [(draw.randrange(200), draw.randrange(200), i, 0, "x", "y", 1 + draw.random() * 50, float(draw.randrange(1, 60))) for i in range(1200)]
    return spark.createDataFrame(rows, EDGE).cache()


def beyond(monkeypatch, whole=False):
    monkeypatch.setattr(routing, "MAX_EDGES", 3)
    monkeypatch.setattr(routing, "ASKED", 5)
    if not whole:
        for name in ("reached", "relax"):
            monkeypatch.setattr(routing, name, lambda *_, **__: pytest.fail("a whole tree is searched"))


def test_costs_of_pairs(spark, graph, monkeypatch):
    """Costs and lengths are those of the packed graph, ties and pairs without a path among them."""
    asked = spark.createDataFrame([(i, 17 * i % 203, 31 * i % 200) for i in range(8)] + [(8, 5, 5), (9, 999, 999), (10, 999, 5)], "pair int, source long, target long")
    plain = lambda: sorted(map(tuple, routing.pair_costs(graph, asked).collect()))
    packed = plain()
    beyond(monkeypatch)
    assert plain() == packed and len(packed) >= 8


def test_paths(spark, graph, monkeypatch):
    """Routes, alternatives (which need larger balls than the best path) and matrices, likewise."""
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    all_three = lambda: (plain(routing.route_nodes(graph, [3, 77, 150])), plain(routing.alternatives(graph, 3, 77)), plain(routing.distance_matrix(graph, [3, 77, 999])))
    packed = all_three()
    beyond(monkeypatch)
    assert all_three() == packed and packed[0] and len({r[0] for r in packed[1]}) == 3


def test_pairs_that_are_left(spark, monkeypatch):
    """Pairs whose ends take too many edges go the other way."""
    path = spark.createDataFrame([(i, i + 1, i, 0, "x", "y", 2.0, 1.0 + i) for i in range(5)], EDGE).cache()
    beyond(monkeypatch, whole=True)
    monkeypatch.setattr(routing, "BALL", 1)
    got = routing.pair_costs(path, spark.createDataFrame([(0, 0, 4), (1, 3, 3), (2, 4, 0)], "pair int, source long, target long")).collect()
    assert {(r["pair"], r["cost"], r["distance_m"]) for r in got} == {(0, 10.0, 8.0), (1, 0.0, 0.0)}
