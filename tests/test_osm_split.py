"""The splitting scan gives the rows of Spark's XML reader, however small the splits."""

import gzip
import random

import pytest

from cartospark.sources import osm_split, osm_xml

VALUES = ["x", "a &gt; b", "a > b", "see --> there", "q &quot;uoted&quot;", "Fish &amp; Co", "ü中", "", "it's", "&#8364;", "/>", "node way"]


def document(seed: int, n: int, line: str, first: int = 0) -> str:
    r = random.Random(seed)
    tags = lambda: "".join(line + f'<tag k="k{r.randrange(5)}" v="{r.choice(VALUES)}"/>' for _ in range(r.randrange(4)))
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<osm version='0.6'>", '<bounds minlat="1" minlon="1" maxlat="2" maxlon="2"/>']
    for i in range(first, first + n):
        kind = r.choice("nnnwwr")
        head = r.choice([f'id="{i}"', f"id='{i}'", f'user="a > b" id="{i}"'])
        if kind == "n":
            at = f'{head} lat="{r.choice(["1.5", "51.25", "x", ""])}" lon="{i / 7:.7f}"'
            out.append(f"<node {at}/>" if r.random() < 0.4 else f"<node {at}>{tags()}{line}</node>")
        elif kind == "w":
            out.append(f"<way {head}>" + "".join(line + f'<nd ref="{r.randrange(n)}"/>' for _ in range(r.randrange(6))) + tags() + "</way>")
        else:
            out.append(f"<relation {head}>" + "".join(line + f'<member type="way" ref="{r.randrange(n)}" role="{r.choice(["outer", ""])}"/>' for _ in range(r.randrange(3))) + tags() + "</relation>")
        if r.random() < 0.1:
            out.append(r.choice(["<!-- a comment -->", '<!-- <node id="0" lat="1" lon="1"/> -->', "<!-- " + '<way id="9"><nd ref="1"/></way>' * 9 + " -->"]))
    return (line or "").join([*out, "</osm>", ""])


def rows(m):
    plain = lambda df, cols: sorted(map(repr, df.select(*cols).collect()))
    return [plain(m.nodes, ["id", "lat", "lon", "tags"]), plain(m.coords, ["id", "lat", "lon"]), plain(m.ways, ["id", "node_refs", "tags"]), plain(m.relations, ["id", "members", "tags"])]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("line", "chunk"), [("\n", 1 << 21), ("", 900)])
def test_rows_equal_the_xml_reader(spark, tmp_path, small_splits, monkeypatch, line, chunk):
    monkeypatch.setattr(osm_split, "CHUNK", chunk)
    p = tmp_path / "a map.osm"
    p.write_text(document(1, 700, line), encoding="utf-8")
    m = osm_xml.read(spark, str(p))
    assert osm_split._records(spark, str(p)).rdd.getNumPartitions() > 20
    assert rows(m) == rows(osm_xml.read_whole(spark, str(p))) and m.ways.count() > 50
    # the order of the source is kept
    for df in (m.nodes, m.ways, m.relations):
        ids = [int(r["id"]) for r in df.orderBy("ord").collect()]
        assert ids == sorted(ids) and df.select("ord").distinct().count() == len(ids)


def test_many_files_packed_ones_and_broken_elements(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.osm").write_text(document(i, 40 * i, "\n", 1000 * i))
    (folder / "9.osm.gz").write_bytes(gzip.compress(document(9, 300, "\n", 9000).encode()))
    assert rows(osm_xml.read(spark, str(folder))) == rows(osm_xml.read_whole(spark, str(folder)))
    (tmp_path / "b.osm").write_text('<osm><node id="1" lat="1" lon="1"><tag k="a" v="b"/></node><node id="2" lat="1" lon="1"><tag k="a" v="b></node><node id="3" lat="2" lon="1"><tag k="a" v="c"/></node><node lat="1" lon="2"><tag k="a" v="d"/></node></osm>')
    assert {r["id"] for r in osm_xml.read(spark, str(tmp_path / "b.osm")).nodes.collect()} == {"1", "3"}
    (tmp_path / "c.osm").write_text("")
    assert osm_xml.read(spark, str(tmp_path / "c.osm")).coords.count() == 0


def test_changes_keep_their_elements(spark, tmp_path):
    """Elements below create and modify are found as well."""
    (tmp_path / "c.osc").write_text('<osmChange><create><node id="1" lat="1" lon="1"/></create><modify><node id="2" lat="1" lon="1"/><way id="3"><nd ref="1"/><nd ref="2"/><tag k="a" v="b"/></way></modify></osmChange>')
    m = osm_xml.read(spark, str(tmp_path / "c.osc"))
    assert m.coords.count() == 2 and m.ways.count() == 1
