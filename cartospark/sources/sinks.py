"""Writers: GeoJSON, JSON, CSV with discovered columns, OSM XML, GraphML, tiles, Shapefile field names.

Rows become text in the JVM. ``lines_to`` writes distributed text files, one
record a line; ``document`` puts such parts together to one file, for formats
that are a single document.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geo, units
from ..plans.model import GeoMap, is_closed
from ..session import scratch

FORMATS = {".geojson": "geojson", ".json": "json", ".csv": "csv", ".xml": "osm", ".osm": "osm", ".shp": "shapefile", ".graphml": "graphml"}


def format_of(path: str, default: str = "geojson") -> str:
    return FORMATS.get(Path(path).suffix.lower(), default)


def feature_json(geometry: Column, properties: Column, id_: Column | None = None) -> Column:
    """One GeoJSON feature as text; geometry is already JSON text, properties a map or struct."""
    head = F.lit('{"type":"Feature",')
    name = F.concat(F.lit('"id":'), F.to_json(F.array(id_.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(id_.cast("string")))) - 2), F.lit(",")) if id_ is not None else F.lit("")
    return F.concat(head, name, F.lit('"geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def point_json(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def _flat(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))


def line_json(coords: Column) -> Column:
    """A line, or, if it ends where it starts and has four points or more, a polygon wound counter-clockwise."""
    ring = (F.size(coords) >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(_flat(geo.wound(coords, True))).alias("coordinates")))
    return F.when(ring, polygon).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), _flat(coords).alias("coordinates"))))


def multipolygon_json(polygons: Column) -> Column:
    """Polygons of rings, outer ones first, wound as RFC 7946 asks."""
    rings = F.transform(polygons, lambda p: F.transform(p, lambda r, i: F.when(i == 0, _flat(geo.wound(r, True))).otherwise(_flat(geo.wound(r, False)))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))


def features(m: GeoMap, include_relations: bool = True) -> DataFrame:
    """(feature): the map's nodes, ways and multipolygons as GeoJSON texts."""
    from ..operators.geometry import geometry_json, multipolygons

    nodes = m.nodes.select(feature_json(point_json(F.col("lon"), F.col("lat")), F.col("tags"), F.col("id")).alias("feature"))
    ways = m.way_geometry().where(F.size("coords") >= 2).select(feature_json(geometry_json(F.col("node_refs"), F.col("tags"), F.col("coords")), F.col("tags"), F.col("id")).alias("feature"))
    out = nodes.unionByName(ways)
    if include_relations and m.relations is not None:
        shapes = multipolygons(m).join(m.relations.select("id", "tags"), "id")
        out = out.unionByName(shapes.select(feature_json(multipolygon_json(F.col("polygons")), F.col("tags"), F.col("id")).alias("feature")))
    return out


def lines_to(rows: DataFrame, path: str) -> None:
    """A text column as distributed files, one record a line (newline-delimited GeoJSON or JSON)."""
    rows.write.mode("overwrite").text(path)


def document(rows: DataFrame, path: str, head: str, between: str, tail: str) -> int:
    """One file of a text column, on any file system that Spark writes; the number of records.

    Tasks write parts, in the order of the rows, to the shared folder. Then the
    file is put together from head, parts and tail, bytes by bytes between file
    systems; no row comes to the driver.
    """
    spark = rows.sparkSession
    parts, seen = scratch(spark, "document"), Observation()
    rows.select(F.col(rows.columns[0]).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", between).text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    shared = source.getFileSystem(conf)
    files = [f for f in shared.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()]
    files.sort(key=lambda f: (len(f.getPath().getName()), f.getPath().getName()))
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for f in files:
            stream = shared.open(f.getPath())
            # the last record has nothing behind it
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, f.getLen() - (len(between.encode()) if f is files[-1] else 0))
            stream.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    shared.delete(source, True)
    return seen.get["n"]


def geojson(rows: DataFrame, path: str, metadata: dict | None = None) -> int:
    tail = "]" + (f',"metadata":{json.dumps(metadata)}' if metadata else "") + "}"
    return document(rows, path, '{"type":"FeatureCollection","features":[', ",\n", tail)


def json_rows(rows: DataFrame, path: str, key: str = "features", metadata: dict | None = None) -> int:
    tail = "]" + (f',"metadata":{json.dumps(metadata)}' if metadata else "") + "}"
    return document(rows.select(F.to_json(F.struct(*rows.columns))), path, f'{{"{key}":[', ",\n", tail)


def tag_columns(rows: DataFrame) -> list[str]:
    """All tag keys of a table, sorted: the columns of a wide file. Keys are counted in parallel; only their names come to the driver."""
    return [r[0] for r in rows.select(F.explode(F.map_keys("tags")).alias("k")).distinct().orderBy("k").collect()]


def wide(m: GeoMap, area: bool = False, length: bool = False, flatten: bool = True) -> DataFrame:
    """Nodes and ways with a column per tag key, or one of all tags as JSON (primary columns, tags, then metadata); ways at their mean vertex."""
    from ..operators.aggregates import elements

    keys = tag_columns(elements(m)) if flatten else []
    tags = [F.col("tags")[k].alias(k) for k in keys] if flatten else [F.to_json("tags").alias("tags")]
    lon, lat = geo.mean_point(F.col("coords"))
    none = F.lit(None)
    nodes = m.nodes.select(F.lit("node").alias("elem"), F.col("id").cast("string").alias("id"), "lat", "lon", "tags", none.cast("int").alias("node_count"), none.cast("boolean").alias("is_closed"), none.cast("double").alias("area_sqm"), none.cast("double").alias("length_m"))
    ways = m.way_geometry().select(F.lit("way").alias("elem"), F.col("id").cast("string").alias("id"), lat.alias("lat"), lon.alias("lon"), "tags", F.size("node_refs").alias("node_count"), is_closed(F.col("node_refs")).alias("is_closed"), geo.area(F.col("coords")).alias("area_sqm"), geo.length(F.col("coords")).alias("length_m"))
    extra = [c for c, on in (("area_sqm", area), ("length_m", length)) if on]
    return nodes.unionByName(ways).select("elem", "id", "lat", "lon", *tags, F.size(F.col("tags")).alias("tag_count"), "node_count", "is_closed", *extra)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


# --- OSM XML

def _tags_xml(tags: Column) -> Column:
    return F.concat_ws("", F.transform(F.map_entries(tags), lambda e: F.concat(F.lit('<tag k="'), units.xml_escaped(e["key"]), F.lit('" v="'), units.xml_escaped(e["value"]), F.lit('"/>'))))


def osm_xml(m: GeoMap, path: str, complete: bool = True) -> int:
    """One OSM XML file; with ``complete`` the untagged nodes that ways refer to are in it, and relations."""
    at = lambda c: F.format_string("%.7f", F.col(c))
    head = lambda tag: F.concat(F.lit(f'<{tag} id="'), units.xml_escaped(F.col("id").cast("string")), F.lit('"'))
    place = F.concat(F.lit(' lat="'), at("lat"), F.lit('" lon="'), at("lon"), F.lit('"'))
    nodes = m.nodes.select(F.lit(0).alias("o"), "ord", F.concat(head("node"), place, F.lit(">"), _tags_xml(F.col("tags")), F.lit("</node>")).alias("x"))
    if complete:
        bare = m.coords.join(m.way_refs().select(F.col("ref").alias("id")), "id", "left_semi").join(m.nodes.select("id"), "id", "left_anti")
        nodes = nodes.unionByName(bare.select(F.lit(1).alias("o"), F.lit(0).cast("long").alias("ord"), F.concat(head("node"), place, F.lit("/>")).alias("x")))
    refs = F.concat_ws("", F.transform("node_refs", lambda r: F.concat(F.lit('<nd ref="'), units.xml_escaped(r.cast("string")), F.lit('"/>'))))
    rows = nodes.unionByName(m.ways.select(F.lit(2).alias("o"), "ord", F.concat(head("way"), F.lit(">"), refs, _tags_xml(F.col("tags")), F.lit("</way>")).alias("x")))
    if complete and m.relations is not None:
        members = F.concat_ws("", F.transform("members", lambda r: F.concat(F.lit('<member type="'), r["type"], F.lit('" ref="'), r["ref"].cast("string"), F.lit('" role="'), units.xml_escaped(r["role"]), F.lit('"/>'))))
        rows = rows.unionByName(m.relations.select(F.lit(3).alias("o"), "ord", F.concat(head("relation"), F.lit(">"), members, _tags_xml(F.col("tags")), F.lit("</relation>")).alias("x")))
    return document(rows.orderBy("o", "ord").select("x"), path, '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">\n', "\n", "\n</osm>\n")


def graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> int:
    """A GraphML file of (id, lat, lon) and (src, dst, length_m, highway, name)."""
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in (("lon", "node", "double"), ("lat", "node", "double"), ("length", "edge", "double"), ("highway", "edge", "string"), ("name", "edge", "string")))
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), units.xml_escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))
    text = lambda c: units.xml_escaped(F.col(c).cast("string"))
    n = nodes.select(F.lit(0).alias("o"), F.concat(F.lit('<node id="'), text("id"), F.lit('">'), data("lon", F.col("lon")), data("lat", F.col("lat")), F.lit("</node>")).alias("x"))
    e = edges.select(F.lit(1).alias("o"), F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('">'), data("length", F.col("length_m")), data("highway", F.col("highway")), data("name", F.col("name")), F.lit("</edge>")).alias("x"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="{"directed" if directed else "undirected"}">\n'
    return document(n.unionByName(e).orderBy("o").select("x"), path, head, "\n", "\n</graph></graphml>\n")


def tiles(rows: DataFrame, path: str, tile: str = "tile") -> None:
    """One folder a tile; empty tiles have none."""
    rows.where(F.col(tile).isNotNull()).write.mode("overwrite").partitionBy(tile).json(path)


def dbf_names(names: list[str]) -> dict[str, str]:
    """Field names of ten characters at most, made different by a numeric ending."""
    out: dict[str, str] = {}
    for n in names:
        short, k = n[:10], 1
        while short in out.values():
            short, k = f"{n[: 10 - len(str(k))]}{k}", k + 1
        out[n] = short
    return out
