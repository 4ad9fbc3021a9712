"""Scans, filters, features, sinks and routing on OSM XML files with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from cartospark.api import Cartographer
from cartospark.functions import geo, units
from cartospark.operators import aggregates, analysis, geometry, network, ordering, routing, scores, spatial
from cartospark.plans import features, filters
from cartospark.plans.model import is_area, is_closed
from cartospark.sources import osm_xml, sinks, tables

SMALL = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="51.5" lon="-0.1"><tag k="amenity" v="restaurant"/><tag k="name" v="Fish &amp; Co"/></node>
<node lon="-0.1001" lat="51.501" id="2"/><node lat="51.502" id="3" lon="-0.1"/>
<node id="4" lat="51.503" lon="-0.1"><tag k="amenity" v="bank"/><tag k="amenity" v="atm"/><tag k="note" v=""/></node>
<way id="90"/><way id="100"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/></way>
<way id="101"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="residential"/><tag k="building:levels" v="3"/></way>
<way id="102"><nd ref="1"/><nd ref="77"/><nd ref="3"/><tag k="highway" v="footway"/></way>
<relation id="7"><member type="way" ref="101" role="outer"/><tag k="type" v="multipolygon"/><tag k="name" v="x"/></relation></osm>"""


def roads_xml(ways, n=6, step=0.001):
    nodes = "".join(f'<node id="{i}" lat="{51 + step * (i // 10)}" lon="{step * (i % 10)}"/>' for i in range(n))
    body = "".join(f'<way id="{100 + k}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{a}" v="{b}"/>' for a, b in tags.items()) + "</way>" for k, (refs, tags) in enumerate(ways))
    return f"<osm>{nodes}{body}</osm>"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("osm") / "small.osm"
    p.write_text(SMALL)
    return osm_xml.read(spark, str(p)), str(p)


def load(spark, tmp_path, xml, name="m.osm"):
    p = tmp_path / name
    p.write_text(xml)
    return osm_xml.read(spark, str(p))


def test_scan(small):
    m, _ = small
    assert m.coords.count() == 4 and m.nodes.count() == 2 and m.ways.count() == 3 and m.relations.count() == 1
    tags = {r["id"]: r["tags"] for r in m.nodes.collect()}
    assert tags["1"]["name"] == "Fish & Co" and tags["4"] == {"amenity": "atm"}
    flags = {r["id"]: (r["c"], r["a"]) for r in m.ways.select("id", is_closed(F.col("node_refs")).alias("c"), is_area(F.col("node_refs"), F.col("tags")).alias("a")).collect()}
    assert flags == {"100": (False, False), "101": (True, True), "102": (False, False)}


def test_empty_file(spark, tmp_path):
    m = load(spark, tmp_path, "<osm></osm>")
    assert m.nodes.count() == m.ways.count() == m.relations.count() == 0
    assert features.extract(m, "amenity").count() == 0 and aggregates.count(m, "amenity").count() == 0
    assert network.components(network.network(m)[1]).count() == 0


def test_missing_reference_is_bridged_for_lines_but_not_for_graphs(small):
    m, _ = small
    assert {r["way_id"]: len(r["coords"]) for r in m.lines().collect()} == {"100": 3, "101": 4, "102": 2}
    assert spatial.segments(m, strict=True).where("way_id = '102'").count() == 0
    assert spatial.segments(m, strict=False).where("way_id = '102'").count() == 1
    assert m.lines("tagged").where("way_id = '100'").first()["coords"][0]["lat"] == 51.5


def test_features_and_filters(small):
    m, _ = small
    assert [r["kind"] for r in features.extract(m, "amenities").orderBy("id").collect()] == ["restaurant", "atm"]
    b = features.buildings(m).first()
    assert b["height_m"] == 9.0 and b["levels"] == 3 and b["area_sqm"] > 0
    f = filters.MapFilter(used_nodes=True).add_accept("ways", "highway", "primary")
    kept = f.apply(m)
    assert [r["id"] for r in kept.ways.collect()] == ["100"] and [r["id"] for r in kept.nodes.collect()] == ["1"]
    assert filters.from_osmosis("reject:highway=a,b") == ("reject", "highway", "a,b") and filters.from_osmosis("nothing") is None
    assert filters.road_levels("1,main,footway")[:2] == ("motorway", "motorway_link")
    assert features.description(F.col("tags")) is not None


def test_sinks_round_trip(spark, small, tmp_path):
    m, path = small
    out = tmp_path / "out.osm"
    sinks.osm_xml(m, str(out))
    back = osm_xml.read(spark, str(out))
    assert back.coords.count() == 4 and back.ways.count() == 3 and back.relations.count() == 1
    assert {r["tags"]["name"] for r in back.nodes.where("id = '1'").collect()} == {"Fish & Co"}
    api = Cartographer(spark)
    assert api.extract_to_geojson(path, str(tmp_path / "x.geojson")) == 6
    raw = json.loads((tmp_path / "x.geojson").read_text())
    assert {f["geometry"]["type"] for f in raw["features"]} == {"Point", "LineString", "Polygon", "MultiPolygon"}
    assert api.extract_to_json(path, str(tmp_path / "x.json")) == 5
    api.extract_to_csv(path, str(tmp_path / "csv"))
    wide = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert {"amenity", "building:levels", "tag_count"} <= set(wide.columns) and wide.count() == 5
    nodes, edges = network.network(m)
    assert sinks.graphml(nodes, edges, str(tmp_path / "g.graphml")) == nodes.count() + edges.count()
    assert sinks.dbf_names(["building:levels", "building:level"]) == {"building:levels": "building:l", "building:level": "building:1"}
    assert api.get_processing_stats()["exports"] == 3 and sinks.format_of("a.OSM") == "osm"
    osm_xml.to_parquet(m, str(tmp_path / "pq"))
    assert osm_xml.from_parquet(spark, str(tmp_path / "pq")).ways.count() == 3


def test_documents_are_put_together_from_parts(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select(F.concat(F.lit('{"é":"'), F.col("id").cast("string"), F.lit('"}')).alias("x"))
    assert sinks.document(rows, f"file://{tmp_path}/a b.json", "[", ",\n", "]é") == 1000
    assert (tmp_path / "a b.json").read_text() == "[" + ",\n".join(f'{{"é":"{i}"}}' for i in range(1000)) + "]é"
    assert sinks.document(rows.where("x = ''"), str(tmp_path / "none.json"), "[", ",", "]") == 0 and (tmp_path / "none.json").read_text() == "[]"
    assert sinks.document(rows.limit(1), str(tmp_path / "none.json"), "[", ",", "]") == 1 and (tmp_path / "none.json").read_text() == '[{"é":"0"}]'


def test_conversions_and_batches(spark, small, tmp_path):
    _, path = small
    api = Cartographer(spark)
    kinds = lambda name: [f["geometry"]["type"] for f in json.loads((tmp_path / name).read_text())["features"]]
    assert api.convert(path, str(tmp_path / "n.geojson"), nodes_only=True) == 2 and set(kinds("n.geojson")) == {"Point"}
    assert api.convert(path, str(tmp_path / "w.out"), form="geojson", ways_only=True) == 3 and "Point" not in kinds("w.out")
    api.convert(path, str(tmp_path / "one.csv"), flatten_tags=False, area=False)
    rows = spark.read.csv(str(tmp_path / "one.csv"), header=True)
    assert rows.columns == ["elem", "id", "lat", "lon", "tags", "tag_count", "node_count", "is_closed", "length_m"] and json.loads(rows.where("id = '100'").first()["tags"]) == {"highway": "primary"}
    assert api.convert(path, str(tmp_path / "x.json")) == 5 and api.convert(path, str(tmp_path / "x.osm")) > 5
    with pytest.raises(ValueError, match="writer"):
        api.convert(path, "x", form="pdf")
    counts = api.amenities_by_type(path, str(tmp_path / "types"))
    assert [tuple(r) for r in counts.collect()] == [("atm", 1, 0, 0), ("restaurant", 1, 0, 0)]
    assert json.loads(spark.read.text(str(tmp_path / "types" / "tile=atm")).first()[0])["properties"] == {"amenity": "atm"}
    assert api.amenities_by_type(path, str(tmp_path / "some"), ["atm"]).count() == 1


def test_merge_last_file_wins(spark, tmp_path):
    for i, n in enumerate(("First", "Second")):
        (tmp_path / f"{i}.osm").write_text(f'<osm><node id="1" lat="1" lon="1"><tag k="name" v="{n}"/></node></osm>')
    m = Cartographer(spark).merge([str(tmp_path / "0.osm"), str(tmp_path / "1.osm")])
    assert [r["tags"]["name"] for r in m.nodes.collect()] == ["Second"]
    with pytest.raises(ValueError, match="two"):
        Cartographer(spark).merge(["a"])


@pytest.mark.parametrize(("oneway", "forward", "back"), [("yes", True, False), ("-1", False, True), ("no", True, True)])
def test_oneway(spark, tmp_path, oneway, forward, back):
    m = load(spark, tmp_path, roads_xml([((0, 1), {"highway": "residential", "oneway": oneway})]))
    e = network.edges(m)
    assert (routing.route_nodes(e, ["0", "1"]).count() > 0) == forward
    assert (routing.route_nodes(e, ["1", "0"]).count() > 0) == back


def test_linear_ring_and_star(spark, tmp_path):
    r = {"highway": "residential"}
    line = network.network(load(spark, tmp_path, roads_xml([((0, 1, 2), r)]), "l.osm"))[1]
    weak = analysis.weak_points(line).collect()
    assert sorted(x["kind"] for x in weak) == ["articulation", "bridge", "bridge"] and {x["a"] for x in weak if x["kind"] == "articulation"} == {"1"}
    ring = network.network(load(spark, tmp_path, roads_xml([((0, 1, 2, 3, 0), r)]), "r.osm"))[1]
    assert analysis.weak_points(ring).count() == 0
    star = network.edges(load(spark, tmp_path, roads_xml([((3, k), r) for k in (0, 1, 2, 4)]), "s.osm"), directed=False)
    best = analysis.betweenness(star).orderBy(F.desc("betweenness")).first()
    assert best["id"] == "3" and best["betweenness"] == pytest.approx(1.0)
    two = network.network(load(spark, tmp_path, roads_xml([((0, 1), r), ((2, 3, 2), r)]), "t.osm"))[1]
    assert network.connectivity(two).count() == 2 and analysis.weak_points(two).where("kind = 'bridge'").count() == 2


def test_grid_routing(spark, tmp_path):
    r = {"highway": "residential", "name": "Row"}
    c = {"highway": "residential", "name": "Column"}
    m = load(spark, tmp_path, roads_xml([(tuple(range(10 * k, 10 * k + 10)), r) for k in range(10)] + [(tuple(range(k, 100, 10)), c) for k in range(10)], n=100))
    e = network.edges(m).cache()
    assert network.connectivity(network.network(m)[1]).first()["size"] == 100
    steps = routing.route_nodes(e, ["0", "99", "0"], "distance_m")
    legs = routing.legs(steps).collect()
    assert legs[0]["n_steps"] == 18 and legs[0]["distance_m"] == pytest.approx(legs[1]["distance_m"], rel=1e-3)
    d = routing.directions(steps.where("leg = 0"), m.coords).collect()
    assert d[-1]["instruction"] == "Arrive at destination" and d[0]["instruction"].startswith("Start on")
    a, b = (dict(x.select("node", F.round("cost", 6)).collect()) for x in (routing.costs(e, ["0"]), routing.relax(e, ["0"])))
    assert a == b and len(a) == 100
    matrix = routing.distance_matrix(e, ["0", "5", "nowhere"])
    assert matrix.where("origin = destination and cost = 0").count() == 2 and matrix.where("cost is null").count() == 5
    assert routing.alternatives(e, "0", "99").select("route").distinct().count() >= 2
    reached, rings = routing.isochrone(m, 51.004, 0.005, [1.0, 3.0], "walk")
    assert 0 < reached.where("zone = 1").count() < reached.count() and rings.count() > 3
    assert analysis.detour_summary(analysis.detours(e, m.coords, 5)).first()["lowest"] >= 0.99
    assert routing.route(m, [(51.0, 0.0), (51.009, 0.009)]).count() == 18
    with_limit = routing.MAX_EDGES
    routing.MAX_EDGES = 10
    try:
        with pytest.raises(ValueError, match="relax"):
            routing.costs(e, ["0"])
    finally:
        routing.MAX_EDGES = with_limit


def test_scores_on_nothing(spark, tmp_path):
    m = load(spark, tmp_path, roads_xml([((0, 1, 2), {"highway": "cycleway", "surface": "asphalt", "maxspeed": "20"})]))
    w, b = scores.walkability(m).first(), scores.bikeability(m).first()
    assert w["grade"] == "F" and b["cycleway_m"] > 0 and b["road_quality"] == 100 and b["topography"] == 70


def test_geometry_values(spark):
    row = spark.range(1).select(
        geo.haversine((F.lit(-0.1278), F.lit(51.5074)), (F.lit(2.3522), F.lit(48.8566))).alias("d"), geo.bearing((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0))).alias("b"),
        units.speed_int(F.lit("30 mph")).alias("s"), units.height(F.lit("40ft")).alias("h"), units.height(F.lit("x")).alias("n"), units.turn(F.lit(-90.0)).alias("t"),
    ).first()
    assert 340_000 < row["d"] < 350_000 and row["b"] == 0 and row["s"] == 48 and row["h"] == pytest.approx(12.192) and row["n"] is None and row["t"] == "Turn left"
    assert units.metres("1km") == 1000 and units.degrees("1km") == pytest.approx(1000 / 111320) and units.file_size(2048) == "2.0 KB"


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    r = random.Random(6)
    values = [0.25, 0.35, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -1.5, -2.675, 0.0, -0.25, 1e15, 123456.125, 123456.375, 8.5e-7] + [round(r.uniform(-1000, 1000), 5) for _ in range(2000)] + [k / 8 for k in range(-400, 400)] + [k / 1000 + 0.0005 for k in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        for row in df.select("v", units.round_half_even(F.col("v"), digits).alias("r")).collect():
            assert row["r"] == round(row["v"], digits), row


def test_thin_and_rings():
    import numpy as np

    assert geometry.thin(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.01, -0.01, 0]), 0.1).tolist() == [0, 3]
    assert geometry.thin(np.array([0.0, 1, 2]), np.array([0.0, 1, 0]), 0.1).tolist() == [0, 1, 2]
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    found = geometry.assemble([square[:3], square[2:]], [hole])
    assert len(found) == 1 and len(found[0]) == 2 and geometry._area(found[0][0]) > 0 > geometry._area(found[0][1])
    assert geometry.join_rings([[(0, 0), (1, 0)]]) == []
    assert len(geometry.smooth(square[:-1], 1)) == 8


def test_tables(spark, tmp_path):
    p = tmp_path / "p.geojson"
    p.write_text(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"a": "b"}}))
    assert tables.polygon(str(p)) == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    assert tables.geojson(spark, str(p)).first()["geometry_type"] == "Polygon"
    (tmp_path / "l.csv").write_text("key,v\n1,a\n1,b\n,c\n")
    ext = tables.lookup(spark, str(tmp_path / "l.csv"), "key")
    rows = spark.createDataFrame([("1", {"x": "1"}), ("2", {})], "id string, tags map<string,string>")
    got = spatial.join_attributes(rows, ext, "id", "key", columns=["v"], prefix="e_").orderBy("id").collect()
    assert [r["e_v"] for r in got] == ["b", None]
    assert tables.points("1,2;3,4,Home\n# no\n") == [("Point 1", 1.0, 2.0), ("Home", 3.0, 4.0)]
    (tmp_path / "b.csv").write_text("name,min_lat,min_lon,max_lat,max_lon\nx,0,0,1,1\n")
    assert tables.bboxes(str(tmp_path / "b.csv")) == [("x", 0.0, 0.0, 1.0, 1.0)]
    assert spatial.grid_shape(5) == (3, 2) and len(spatial.grid(0, 0, 1, 1, 2, 2)) == 4


def test_stream(spark, tmp_path):
    from cartospark.streaming import counts

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.osm").write_text(SMALL.replace("><tag", ">\n<tag").replace("/><tag", "/>\n<tag"))
    q = counts.count_values(counts.tag_stream(spark, str(folder), "highway"), "tag_counts", str(tmp_path / "ck"))
    q.awaitTermination()
    assert dict(spark.sql("select value, n from tag_counts").collect()) == {"primary": 1, "footway": 1}
    assert ordering.overlap(F.array(F.lit(1)), F.array(F.lit(1))) is not None


def test_pictures_and_shapefiles(small, tmp_path):
    import struct

    from cartospark.sources import maps

    m, _ = small
    assert maps.png(m, str(tmp_path / "m.png"), 60, 40, "dark") == 5
    raw = (tmp_path / "m.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (60, 40)
    assert maps.leaflet(m, str(tmp_path / "m.html"), "<t>") == 5 and "&lt;t&gt;" in (tmp_path / "m.html").read_text()
    assert maps.shapefile(m, str(tmp_path / "s")) == {"points": 2, "lines": 2, "polygons": 1}
    shp = (tmp_path / "s_polygons.shp").read_bytes()
    assert struct.unpack(">i", shp[:4]) == (9994,) and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    limit, maps.MAX_SHAPES = maps.MAX_SHAPES, 1
    try:
        with pytest.raises(ValueError, match="clip"):
            maps.png(m, str(tmp_path / "n.png"))
    finally:
        maps.MAX_SHAPES = limit
