"""Small inputs: polygons, lookup tables, points, bounding boxes, GeoJSON features."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def polygon(path: str) -> Ring:
    """Outer ring of a GeoJSON file's first polygon (of a multipolygon the first), without the closing point."""
    raw = json.loads(Path(path).read_text())
    shapes = [f.get("geometry") for f in raw["features"]] if raw.get("type") == "FeatureCollection" else [raw.get("geometry") if raw.get("type") == "Feature" else raw]
    for g in shapes:
        if g and g["type"] in ("Polygon", "MultiPolygon"):
            ring = g["coordinates"][0] if g["type"] == "Polygon" else g["coordinates"][0][0]
            ring = [(float(p[0]), float(p[1])) for p in ring]
            return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    raise ValueError(f"no polygon in {path}")


def lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with header, a JSON list of objects, or the properties of GeoJSON features, as text columns and ``ord``; empty keys are dropped."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
    else:
        rows = spark.read.json(path, multiLine=True)
        if "features" in rows.columns:
            rows = rows.select(F.explode("features").alias("f")).select("f.properties.*")
    rows = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns))
    return rows.withColumn("ord", F.monotonically_increasing_id()).where(F.col(key).isNotNull() & (F.col(key) != ""))


def points(text: str) -> list[tuple[str, float, float]]:
    """(name, lat, lon) of "lat,lon[,name]" items, separated by ";" or one a line; "#" starts a comment."""
    out = []
    for item in (x.strip() for line in text.splitlines() for x in line.split(";")):
        if item and not item.startswith("#"):
            parts = [p.strip() for p in item.split(",", 2)]
            out.append((parts[2] if len(parts) > 2 else f"Point {len(out) + 1}", float(parts[0]), float(parts[1])))
    return out


def bboxes(path: str) -> list[tuple[str, float, float, float, float]]:
    """(name, min_lat, min_lon, max_lat, max_lon) of a CSV or JSON list."""
    p = Path(path)
    rows = json.loads(p.read_text()) if p.suffix == ".json" else list(csv.DictReader(p.open(newline="")))
    return [(str(r.get("name") or i), *(float(r[k]) for k in ("min_lat", "min_lon", "max_lat", "max_lon"))) for i, r in enumerate(rows)]


_FEATURE = "struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, geometry_type, lines, properties): each feature's points as array of lines; a point or line is one line, a polygon its rings."""
    rows = spark.read.option("multiLine", True).schema(f"type string, features array<{_FEATURE}>, geometry struct<type: string, coordinates: string>, properties map<string, string>, id string").json(path)
    one = F.when(F.col("geometry").isNotNull(), F.array(F.struct("id", "geometry", "properties")))
    f = rows.select(F.explode(F.coalesce("features", one)).alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point, line, poly = (F.from_json(raw, t) for t in ("array<double>", "array<array<double>>", "array<array<array<double>>>"))
    pts = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    lines = F.when(kind == "Point", F.array(pts(F.array(point)))).when(kind == "LineString", F.array(pts(line))).when(kind == "Polygon", F.transform(poly, pts))
    return f.select(F.col("f.id").alias("id"), kind.alias("geometry_type"), lines.alias("lines"), F.col("f.properties").alias("properties"))
