"""The walks from reached nodes to POIs: the least of all pairs, from few of them."""

import math
import random

import pytest

from cartospark.constants import R_ROUND
from cartospark.operators import routing


def metres(a, b):
    (x, y), (u, v) = ([math.radians(c) for c in p] for p in (a, b))
    return 2 * R_ROUND * math.asin(math.sqrt(math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2))


def test_least_walks(spark):
    draw = random.Random(5)
    place = lambda: (51 + draw.random() * 0.05, draw.random() * 0.08)
    nodes = [(i, *place(), draw.random() * 3000) for i in range(1500)] + [(2000, 51.2, 0.3, 5.0)]
    pois = [(i, *place(), "x") for i in range(150)] + [(900, 51.213, 0.3, "x"), (901, 51.3, 0.3, "x")]  # one at the rim, one out of reach
    best = {}
    for i, lat, lon, _ in pois:
        costs = [c + d / 1.25 for _, y, x, c in nodes if (d := metres((lat, lon), (y, x))) <= 1500]
        if costs:
            best[i] = min(costs)
    got = routing._walks(spark.createDataFrame(pois, "id long, lat double, lon double, name string"), spark.createDataFrame(nodes, "id long, lat double, lon double, cost double"), 1500.0, 1.25).select("id", "cost_s").collect()
    least = {}
    for r in got:
        least[r["id"]] = min(least.get(r["id"], math.inf), r["cost_s"])
    assert least == pytest.approx(best) and 900 in best and 901 not in best
    assert len(got) < 150 * 20  # of some 300 nodes around each
