"""Network queries read every way, whatever its id: against brute force on a small network."""

import math

import pytest

from cartospark import queries as maps
from cartospark.operators import analysis, network, routing
from cartospark.plans.model import GeoMap

#: A path into a triangle, a road apart, and one road with a small id.
WAYS = {5000: [1, 2, 3, 4], 5001: [4, 5, 6, 4], 5002: [7, 8], 10: [9, 10]}
PAIRS = {(min(a, b), max(a, b)) for refs in WAYS.values() for a, b in zip(refs, refs[1:], strict=False)}


@pytest.fixture
def roads(spark, monkeypatch):
    coords = spark.createDataFrame([(i, 51.5 + 0.002 * (i % 4) + 0.00003 * i * i, -0.1 + 0.002 * (i // 4) + 0.0001 * (i * i % 7)) for i in range(1, 11)], "id long, lat double, lon double")
    nodes = spark.createDataFrame([(1, 51.502, -0.1, {"amenity": "school"}, 1)], "id long, lat double, lon double, tags map<string,string>, ord long")
    ways = spark.createDataFrame([(i, r, {"highway": "residential", "name": "x"}, i) for i, r in WAYS.items()], "id long, node_refs array<long>, tags map<string,string>, ord long")
    m = GeoMap(nodes, coords, ways)
    monkeypatch.setattr(maps.M, "star", lambda *_: m)
    return m


def closure(pairs, nodes=range(1, 11)):
    label = {i: i for i in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    return label


def shortest(edges, source, weight):
    best = {source: (0.0, 0.0)}
    for _ in range(20):
        for e in edges:
            if e["src"] in best:
                d, m = best[e["src"]]
                best[e["dst"]] = min(best.get(e["dst"], (math.inf, 0.0)), (d + e[weight], m + e["distance_m"]))
    return best


def test_all_ways_are_read(spark, roads):
    run = lambda name: [tuple(r) for r in maps.QUERIES[name](spark, "").collect()]
    label = closure(PAIRS)
    assert dict(run("components")) == label
    assert {c: n for c, n, _ in run("connectivity")} == {c: list(label.values()).count(c) for c in set(label.values())}
    assert set(run("bridges")) == {p for p in PAIRS if closure(PAIRS - {p}) != label}
    pieces = {i: len(set(closure({p for p in PAIRS if i not in p}, [j for j in range(1, 11) if j != i]).values())) - len(set(label.values())) for i in range(1, 11)}
    assert dict(run("articulation")) == {i: n for i, n in pieces.items() if n > 0}
    best = {i: round(c, 1) for i, (c, _) in shortest(network.edges(roads).collect(), 1, "time_s").items()}
    assert dict(run("sssp_time")) == dict(run("sssp_packed")) == best and len(best) == 6
    assert {(a, b) for a, b, c, _ in run("distance_matrix") if c is not None} == {(a, b) for a in range(1, 7) for b in range(1, 7)}
    assert [r[2:4] for r in run("route")] == [(1, 2), (2, 3), (3, 4)] and run("directions")[-1][1] == "Arrive at destination"
    assert {r[2:4] for r in run("alternatives")} == {(1, 2)} and len(run("detour")) > 0
    assert {i for i, *_ in run("isochrone")} == {i for i, *_ in run("walk_isochrone")} | {1, 2, 3, 4, 5, 6} and run("isochrone_bins") and run("catchment")
    assert {i for i, _ in run("betweenness")} == set(range(1, 11))


def test_costs_beyond_the_packed_limit(spark, roads, monkeypatch):
    """Isochrones and distance matrices of a network with too many edges to pack."""
    monkeypatch.setattr(routing, "MAX_EDGES", 3)
    e = network.edges(roads)
    rows = e.collect()
    got = {(r["origin"], r["destination"]): (r["cost"], r["distance_m"]) for r in routing.distance_matrix(e, [1, 5, 7]).collect()}
    for a in (1, 5, 7):
        best = shortest(rows, a, "time_s")
        for b in (1, 5, 7):
            assert got[a, b] == (pytest.approx(best[b]) if b in best else (None, None))
    reached, _ = routing.isochrone(roads, 51.502, -0.1, [0.5, 1.0], "drive")
    costs = {i: c for i, (c, _) in shortest(rows, 1, "time_s").items() if c <= 60}
    assert {r["id"]: r["cost"] for r in reached.collect()} == pytest.approx(costs)


def test_paths_beyond_the_packed_limit(spark, roads, monkeypatch):
    """Routes and alternatives by joins are those of the packed graph, and a leg without a path leaves none."""
    e = network.edges(roads, directed=False)
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    stops = [[1, 6, 2], [1, 7]]
    packed = [plain(routing.route_nodes(e, s)) for s in stops], plain(routing.alternatives(e, 1, 5, 2))
    assert [len(x) > 0 for x in packed[0]] == [True, False]
    monkeypatch.setattr(routing, "MAX_EDGES", 3)
    assert ([plain(routing.route_nodes(e, s)) for s in stops], plain(routing.alternatives(e, 1, 5, 2))) == packed


def test_betweenness_and_detours_by_brute_force(spark, roads, monkeypatch):
    """Shares of all shortest paths, path by path; the roads have no two equal ones."""
    e = network.edges(roads, directed=False)
    rows = e.collect()
    through = dict.fromkeys(range(1, 11), 0.0)
    for a in range(1, 11):
        best = {a: (0.0, [a])}
        for _ in range(12):
            for r in rows:
                if r["src"] in best:
                    d, p = best[r["src"]]
                    best[r["dst"]] = min(best.get(r["dst"], (math.inf, [])), (d + r["distance_m"], [*p, r["dst"]]))
        for b, (_, p) in best.items():
            for v in p[1:-1]:
                through[v] += (b != a) / (9 * 8)
    for limit in (routing.MAX_EDGES, 3):  # sent to the workers, and by joins
        monkeypatch.setattr(routing, "MAX_EDGES", limit)
        got = {r["id"]: r["betweenness"] for r in analysis.betweenness(e).collect()}
        assert got == pytest.approx(through)
    out = analysis.detours(e, roads.coords, 20).collect()
    for r in out:
        assert r["network_m"] == pytest.approx(shortest(rows, r["origin"], "distance_m")[r["destination"]][0]) and r["factor"] == pytest.approx(r["network_m"] / r["straight_m"]) and r["straight_m"] >= 100
    assert out and {r["origin"] for r in out} <= set(range(1, 7))


def test_betweenness_with_equal_paths(spark, monkeypatch):
    """A lattice, full of equal paths, and two edges of length 0: by joins as in the workers."""
    at = lambda x, y: 10 * x + y
    pairs = [(at(x, y), at(x + dx, y + dy), 1.0) for x in range(4) for y in range(4) for dx, dy in ((0, 1), (1, 0)) if x + dx < 4 and y + dy < 4] + [(at(3, 3), 99, 0.0), (99, 98, 0.0), (5, 5, 1.0)]
    rows = [(a, b, i, 0, "x", "y", m, m) for i, (a, b, m) in enumerate(pairs)]
    e = spark.createDataFrame(rows + [(b, a, *r) for a, b, *r in rows], "src long, dst long, way_id long, pos int, highway string, name string, distance_m double, time_s double")
    plain = lambda: {r["id"]: r["betweenness"] for r in analysis.betweenness(e, samples=9).collect()}
    packed = plain()
    monkeypatch.setattr(routing, "MAX_EDGES", 3)
    assert plain() == pytest.approx(packed) and len(packed) == 18


def test_parts_of_a_graph_that_is_too_large_to_pack(spark, monkeypatch):
    """Parts go to tasks of their own, what is larger is relaxed; a source that no edge leaves reaches itself."""
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (11, 12), (12, 13), (13, 14), (21, 22), (22, 21), (30, 31)] + [(a, a + 1) for a in range(40, 52)]
    rows = [(a, b, 7 * a, i % 3, "x", "y", 1.0 + a % 5, 2.0 + b % 3) for i, (a, b) in enumerate(pairs)]
    e = spark.createDataFrame(rows, "src long, dst long, way_id long, pos int, highway string, name string, distance_m double, time_s double")
    sources = [1, 3, 11, 13, 22, 31, 40, 99]
    plain = lambda: {(r["source"], r["node"]): (r["cost"], r["distance_m"]) for r in routing.costs(e, sources).collect()}
    packed = plain()
    assert (31, 31) in packed and (40, 52) in packed and not any(99 in k for k in packed)
    monkeypatch.setattr(routing, "MAX_EDGES", 5)  # the path of twelve edges is relaxed
    got = plain()
    assert got.keys() == packed.keys() and all(got[k] == pytest.approx(packed[k]) for k in got)
    monkeypatch.setattr(routing, "HOPS", 1)
    again = plain()
    assert again.keys() == packed.keys() and all(again[k] == pytest.approx(packed[k]) for k in again)
