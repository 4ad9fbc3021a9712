"""Components along directed edges against plain reachability."""

import random

from cartospark.operators import network


def reachable(nodes, pairs):
    ahead = {i: {i} for i in nodes}
    for _ in nodes:
        for a, b in pairs:
            ahead[a] |= ahead[b]
    return ahead


def test_components_along_directed_edges(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(30)] + [(40 + i, 40 + (i + 1) % 9) for i in range(9)] + [(60 + r.randrange(25), 60 + r.randrange(25)) for _ in range(45)] + [(12, 3), (90, 90), (48, 100), (100, 101), (101, 100)]
    nodes = sorted({i for p in pairs for i in p})
    ahead = reachable(nodes, pairs)
    e = spark.createDataFrame(pairs, "src long, dst long")
    weak = dict(map(tuple, network.reach_components(e).collect()))
    assert weak == {i: min(j for j in nodes if i in ahead[j]) for i in nodes}
    # the same as a search from every node in turn
    seen = {}
    for s in nodes:
        for v in ahead[s]:
            seen.setdefault(v, s)
    assert weak == seen
    strong = dict(map(tuple, network.strong_components(e).collect()))
    assert strong == {i: min(j for j in nodes if i in ahead[j] and j in ahead[i]) for i in nodes}
    row = network.directed_stats(e).first()
    out = {i: {b for a, b in pairs if a == i} for i in nodes}
    assert row["nodes"] == len(nodes) and row["components"] == len(set(weak.values())) and row["dead_ends"] == sum(len(v) == 1 for v in out.values()) and row["intersections"] == sum(len(v) >= 3 for v in out.values())
    nothing = spark.createDataFrame([], "src long, dst long")
    assert network.strong_components(nothing).count() == 0 == network.reach_components(nothing).count()
