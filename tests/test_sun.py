"""Sun positions against known angles, hulls and shadows against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cartospark import testmap
from cartospark.operators import sun
from cartospark.plans.model import GeoMap


def test_known_angles(spark):
    def at(lat, day, hour):
        alt, az = sun.position(lat, day, hour)
        return tuple(spark.range(1).select(alt, az).first())

    assert at(0.0, 81, 12.0)[0] == pytest.approx(90, abs=0.5)  # equinox at the equator
    assert at(51.5, 172, 12.0) == (pytest.approx(90 - 51.5 + 23.45, abs=0.01), pytest.approx(180, abs=1e-3))  # midsummer noon in London
    assert at(51.5, 355, 12.0)[0] == pytest.approx(90 - 51.5 - 23.45, abs=0.01)  # midwinter
    assert at(-33.9, 355, 12.0)[1] == pytest.approx(0, abs=1e-3)  # the sun stands north at noon in the south
    morning, evening = at(40.0, 81, 6.0), at(40.0, 81, 18.0)
    assert morning == (pytest.approx(0, abs=0.1), pytest.approx(90, abs=0.1)) and evening[1] == pytest.approx(270, abs=0.1)
    assert at(90.0, 172, 3.0)[0] == pytest.approx(23.45, abs=0.01)  # the pole has no direction, and no error
    assert at(80.0, 355, 12.0)[0] < 0


def plain_hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points
    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out
    return half(points)[:-1] + half(points[::-1])[:-1]


def test_hulls(spark):
    rnd = random.Random(5)
    sets = [[(float(rnd.randrange(k)), float(rnd.randrange(k))) for _ in range(n)] for k in (2, 5, 40) for n in (1, 2, 3, 8, 25) for _ in range(6)]
    rows = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in s]) for i, s in enumerate(sets)], "i int, p array<struct<lon: double, lat: double>>")
    for r in rows.select("i", sun.hull(F.col("p")).alias("h")).collect():
        h = [(p["lon"], p["lat"]) for p in r["h"]]
        assert h[0] == h[-1] and h[:-1] == plain_hull(sets[r["i"]]), sets[r["i"]]


def _map(spark, ways, heights):
    coords = [(f"{w}.{i}", y, x) for w, ring in ways.items() for i, (x, y) in enumerate(ring)]
    nodes = spark.createDataFrame([], "id string, lat double, lon double, tags map<string,string>, ord long")
    rows = [(w, [f"{w}.{i}" for i in range(len(ring))] + [f"{w}.0"], {"building": "yes", **({"height": heights[w]} if heights[w] else {})}, 0) for w, ring in ways.items()]
    return GeoMap(nodes, spark.createDataFrame(coords, "id string, lat double, lon double"), spark.createDataFrame(rows, "id string, node_refs array<string>, tags map<string,string>, ord long"))


def test_shadows_and_shaded_points(spark):
    k = 1 / (111320 * math.cos(math.radians(51.5)))  # a metre to the east
    v = 1 / 111320
    box = lambda x, y, w, d: [(x * k, 51.5 + y * v), ((x + w) * k, 51.5 + y * v), ((x + w) * k, 51.5 + (y + d) * v), (x * k, 51.5 + (y + d) * v)]
    dented = [(100 * k, 51.5), (160 * k, 51.5), (160 * k, 51.5 + 40 * v), (150 * k, 51.5 + 40 * v), (150 * k, 51.5 + 10 * v), (110 * k, 51.5 + 10 * v), (110 * k, 51.5 + 40 * v), (100 * k, 51.5 + 40 * v)]
    ways = {"a": box(0, 0, 10, 20), "b": dented, "c": box(300, 0, 5, 5)}
    m = _map(spark, ways, {"a": "30 m", "b": "8", "c": None})
    shadow = sun.shadows(m, 355, (0.0, 12.0, 14.0)).checkpoint()
    rows = {(r["id"], r["hour"]): r for r in shadow.collect()}
    assert {h for _, h in rows} == {12.0, 14.0} and len(rows) == 6  # no shadows at night
    noon = rows["a", 12.0]
    assert noon["length_m"] == pytest.approx(30 / math.tan(math.radians(15.05)), rel=1e-2) and noon["height_m"] == 30
    assert noon["area_sqm"] == pytest.approx(10 * (20 + noon["length_m"]), rel=1e-3)  # due north: as wide as the house
    assert rows["c", 12.0]["height_m"] == 10

    rnd = random.Random(3)
    spots = [(i, rnd.uniform(-80, 420) * k, 51.5 + rnd.uniform(-30, 180) * v) for i in range(600)]
    spots.append((600, 130 * k, 51.5 + 38 * v))  # in the dent
    inside = lambda x, y, ring: sum((a[1] > y) != (b[1] > y) and x < (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2
    want = {}
    for i, x, y in spots:
        for (w, hour), r in rows.items():
            if any(inside(x - r["east"] * t / 1000, y - r["north"] * t / 1000, ways[w]) for t in range(1001)):
                want[i, hour] = want.get((i, hour), 0) + 1
    points = spark.createDataFrame(spots, "id long, lon double, lat double")
    for cell in (0.002, 0.0003):
        got = {(r["id"], r["hour"]): r["n"] for r in sun.shaded(points, shadow, cell).collect()}
        assert len(got) > 60 and {x for x in set(got.items()) ^ set(want.items())} == set()


def test_no_buildings(spark):
    m = testmap.star(spark, "/root/testdata/sf0.001")
    assert sun.shadows(m.with_(ways=m.ways.where("false")), 172).count() == 0
