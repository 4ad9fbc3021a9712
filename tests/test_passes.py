"""Maps are read and put together once for what is asked of them."""

from cartospark import testmap
from cartospark.operators import network, scores

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_join_the_roads_once(spark):
    m = testmap.star(spark, SF)
    links, edges = network.links(m), network.network(m)[1].select("src", "dst")
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, edges.collect()))
    assert plan(links).count("Join ") < plan(edges).count("Join ")


def test_walk_map_reads_stored_edges_and_points(spark):
    m = testmap.star(spark, SF)
    rows = scores.walkability_map(m, radius=3000.0, bounds=(51.0, -0.5, 52.0, 0.5), cells=(2, 2))
    assert "Window" not in plan(rows) and "collect_list" not in plan(rows)


def test_bikeability_puts_ways_together_once(spark):
    m = testmap.star(spark, SF)
    assert plan(scores.bikeability(m, 51.5, -0.1, 20_000.0)).count("collect_list(") == 1
