"""Searches through the overlay against Dijkstra's algorithm on the roads."""

import random

import pytest

from cartospark.operators import overlay, routing


@pytest.fixture(scope="module")
def town(spark):
    """A lattice of 9 x 9 with one-way streets and unequal lengths, and two nodes apart."""
    r = random.Random(2)
    rows, coords = [], [(10 * x + y, 51 + y / 100, x / 100) for x in range(9) for y in range(9)] + [(500, 51.2, 0.2), (501, 51.21, 0.2)]
    pairs = [(10 * x + y, 10 * (x + dx) + y + dy) for x in range(9) for y in range(9) for dx, dy in ((0, 1), (1, 0)) if x + dx < 9 and y + dy < 9] + [(500, 501), (3, 3)]
    for i, (a, b) in enumerate(pairs):
        m = 100 + 50 * r.random()
        both = r.random() < 0.9
        rows += [(a, b, i, 0, "residential", f"street {i % 5}", m, m / (5 + i % 3))] + ([(b, a, i, 0, "residential", f"street {i % 5}", m, m / (5 + i % 3))] if both else [])
    edges = spark.createDataFrame(rows, "src long, dst long, way_id long, pos int, highway string, name string, distance_m double, time_s double")
    return edges, spark.createDataFrame(coords, "id long, lat double, lon double")


def test_costs_and_paths_are_those_of_the_roads(spark, town, tmp_path):
    edges, coords = town
    o = overlay.build(edges, coords, cell_nodes=12, path=f"file://{tmp_path}/o")
    assert o.cells.groupBy("cell").count().where("count > 12").count() == 0 and o.cells.select("cell").distinct().count() == 7
    ends = [0, 88, 44, 500, 7, 999]
    plain = {(r["origin"], r["destination"]): (r["cost"], r["distance_m"]) for r in routing.distance_matrix(edges, ends).collect()}
    got = {(r["origin"], r["destination"]): (r["cost"], r["distance_m"]) for r in overlay.distance_matrix(overlay.load(spark, f"file://{tmp_path}/o"), ends).collect()}
    assert set(got) == set(plain) and sum(v[0] is not None for v in got.values()) > 15
    for k, v in plain.items():
        assert got[k] == (pytest.approx(v) if v[0] is not None else (None, None))
    stops = [0, 88, 44, 44, 7]
    cols = ["leg", "seq", "src", "dst", "way_id", "name"]
    path = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert path(overlay.route_nodes(o, stops)) == path(routing.route_nodes(edges, stops))
    assert overlay.route_nodes(o, [0, 500]).count() == 0
