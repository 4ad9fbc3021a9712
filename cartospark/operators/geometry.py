"""Line and ring operators over ways, simplification and multipolygon assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import R_MEAN
from ..functions import geo
from ..plans.model import GeoMap
from ..session import ship

RING = "array<struct<lon: double, lat: double>>"


def measures(m: GeoMap, radius: float = R_MEAN, coord_scope: str = "all") -> DataFrame:
    """(id, n_points, length_m, straight_m, sinuosity, bearing) of every way with two points or more."""
    c = F.col("coords")
    rows = m.lines(coord_scope).where(F.size("coords") >= 2)
    return rows.select(F.col("way_id").alias("id"), F.size(c).alias("n_points"), geo.length(c, radius).alias("length_m"), geo.straight(c, radius).alias("straight_m"), geo.sinuosity(c, radius).alias("sinuosity"), geo.line_bearing(c).alias("bearing"))


def centroids(m: GeoMap) -> DataFrame:
    """(id, lon, lat): the mean vertex of every way."""
    lon, lat = geo.mean_point(F.col("coords"))
    return m.lines().select(F.col("way_id").alias("id"), lon.alias("lon"), lat.alias("lat"))


def midpoints(m: GeoMap) -> DataFrame:
    """(id, lon, lat): the point half-way along every way."""
    return m.lines().select(F.col("way_id").alias("id"), geo.midpoint(F.col("coords")).alias("p")).select("id", "p.lon", "p.lat")


def rings(m: GeoMap) -> DataFrame:
    """(id, coords, area_sqm, ccw) of ways with three points or more, closed."""
    c = F.col("coords")
    return m.lines().where(F.size("coords") >= 3).select(F.col("way_id").alias("id"), geo.closed(c).alias("coords")).select("id", "coords", geo.area(c).alias("area_sqm"), geo.is_ccw(c).alias("ccw"))


def geometry_json(refs: Column, tags: Column, coords: Column) -> Column:
    """GeoJSON geometry text of a way: a polygon if it is an area of four points or more, else a line."""
    from ..plans.model import is_area

    flat = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(flat).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), flat.alias("coordinates")))
    return F.when(is_area(refs, tags) & (F.size(coords) >= 4), polygon).otherwise(line)


def thin(lon: np.ndarray, lat: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: positions that stay. A closed part measures against its end point. The farthest vertex, the first of equals, splits."""
    keep = np.zeros(len(lon), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(lon) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        x, y = lon[a + 1 : b], lat[a + 1 : b]
        dx, dy = lon[b] - lon[a], lat[b] - lat[a]
        square = dx * dx + dy * dy
        if square == 0:
            d = np.hypot(x - lon[a], y - lat[a])
        else:
            t = np.clip(((x - lon[a]) * dx + (y - lat[a]) * dy) / square, 0, 1)
            d = np.hypot(x - (lon[a] + t * dx), y - (lat[a] + t * dy))
        k = int(np.argmax(d))
        if d[k] > tolerance:
            k += a + 1
            keep[k] = True
            todo += [(a, k), (k, b)]
    return np.flatnonzero(keep)


def simplify(lines: DataFrame, tolerance: float, id_col: str = "way_id") -> DataFrame:
    """(id, coords, n_before, n_after): every line thinned to a tolerance in degrees. Recursive by nature, so in Arrow batches."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for i, lon, lat in zip(pdf["id"], pdf["lon"], pdf["lat"], strict=True):
                at = thin(lon, lat, tolerance) if len(lon) > 2 else np.arange(len(lon))
                rows.append((i, [{"lon": float(lon[k]), "lat": float(lat[k])} for k in at], len(lon), len(at)))
            yield pd.DataFrame(rows, columns=["id", "coords", "n_before", "n_after"])

    ship(lines.sparkSession)
    flat = lines.select(F.col(id_col).alias("id"), F.col("coords.lon").alias("lon"), F.col("coords.lat").alias("lat"))
    return flat.mapInPandas(run, f"id {dict(flat.dtypes)['id']}, coords {RING}, n_before long, n_after long")


def densify(m: GeoMap, interval: float) -> DataFrame:
    """(id, coords) with no segment longer than about ``interval`` metres."""
    return m.lines().select(F.col("way_id").alias("id"), geo.densified(F.col("coords"), interval).alias("coords"))


def buffer_points(points: DataFrame, metres: float, n: int = 32) -> DataFrame:
    """Points with a ring of the given radius around each."""
    return points.withColumn("ring", geo.circle((F.col("lon"), F.col("lat")), metres, n))


# --- multipolygons

_NEAR = 1e-9


def join_rings(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from open and closed parts, greedily: the first part that continues at either end is taken; rings that stay open are dropped."""
    same = lambda p, q: abs(p[0] - q[0]) < _NEAR and abs(p[1] - q[1]) < _NEAR
    left, out = [list(p) for p in parts if len(p) >= 2], []
    while left:
        ring = left.pop(0)
        while not same(ring[0], ring[-1]):
            for i, p in enumerate(left):
                if same(ring[-1], p[0]):
                    ring += p[1:]
                elif same(ring[-1], p[-1]):
                    ring += p[-2::-1]
                elif same(ring[0], p[-1]):
                    ring = p[:-1] + ring
                elif same(ring[0], p[0]):
                    ring = p[:0:-1] + ring
                else:
                    continue
                left.pop(i)
                break
            else:
                break
        if len(ring) >= 4 and same(ring[0], ring[-1]):
            out.append(ring)
    return out


def _area(r: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def assemble(outers: list[list[tuple[float, float]]], inners: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outer ring counter-clockwise, then holes clockwise); a hole goes to the smallest outer ring around its first point."""
    turned = lambda r, ccw: r if (_area(r) > 0) == ccw else r[::-1]
    rings = [turned(r, True) for r in join_rings(outers)]
    polygons = [[r] for r in rings]
    for hole in join_rings(inners):
        around = [(abs(_area(r)), i) for i, r in enumerate(rings) if _inside(hole[0], r)]
        if around:
            polygons[min(around)[1]].append(turned(hole, False))
    return polygons


def multipolygons(m: GeoMap) -> DataFrame:
    """(id, polygons) of relations tagged type=multipolygon, assembled from their member ways.

    Members keep the relation's order; way members without a role are outer.
    Assembly is sequential inside a relation, relations are independent.
    """
    relations = m.relations.where(F.col("tags")["type"] == "multipolygon")
    members = relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("no", "m")).where("m.type = 'way'").select("rel_id", "no", F.col("m.ref").alias("way_id"), F.coalesce(F.col("m.role"), F.lit("")).alias("role")).where("role in ('outer', 'inner', '')")
    rows = members.join(m.lines(), "way_id").select("rel_id", "no", F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role"), F.col("coords.lon").alias("lon"), F.col("coords.lat").alias("lat"))
    kind = dict(rows.dtypes)["rel_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        parts = {r: [list(zip(x, y, strict=True)) for q, x, y in zip(pdf["role"], pdf["lon"], pdf["lat"], strict=True) if q == r] for r in ("outer", "inner")}
        found = assemble(parts["outer"], parts["inner"])
        return pd.DataFrame({"id": [pdf["rel_id"].iloc[0]], "polygons": [[[[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in poly] for poly in found]]})

    ship(rows.sparkSession)
    return rows.groupBy("rel_id").applyInPandas(run, f"id {kind}, polygons array<array<{RING}>>").where(F.size("polygons") > 0)


def radial_ring(points: DataFrame, lon0: float, lat0: float, bins: int = 36) -> DataFrame:
    """(bin, lon, lat): of the points around a centre the farthest in each direction; an empty direction between two filled ones gets their mean."""
    at = F.floor((F.atan2(F.col("lat") - lat0, F.col("lon") - lon0) + math.pi) / (2 * math.pi / bins)).cast("int") % bins
    d = F.pow(F.col("lat") - lat0, F.lit(2)) + F.pow(F.col("lon") - lon0, F.lit(2))
    far = points.groupBy(at.alias("bin")).agg(F.max_by(F.struct("lon", "lat"), F.struct(d, "lon", "lat")).alias("p"))
    grid = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(far), "bin", "left")  # `bins` rows
    side = lambda k: F.broadcast(far.select(((F.col("bin") + k) % bins).alias("bin"), F.col("p").alias("before" if k == 1 else "after")))
    grid = grid.join(side(1), "bin", "left").join(side(bins - 1), "bin", "left")
    fill = lambda k: F.coalesce(F.col("p")[k], (F.col("before")[k] + F.col("after")[k]) / 2)
    return grid.select("bin", fill("lon").alias("lon"), fill("lat").alias("lat")).where("lon is not null")


def smooth(ring: list[tuple[float, float]], rounds: int = 3) -> list[tuple[float, float]]:
    """Chaikin corner cutting of a closed ring (a handful of points, on the driver)."""
    for _ in range(rounds):
        ring = [q for a, b in zip(ring, ring[1:] + ring[:1], strict=True) for q in ((0.75 * a[0] + 0.25 * b[0], 0.75 * a[1] + 0.25 * b[1]), (0.25 * a[0] + 0.75 * b[0], 0.25 * a[1] + 0.75 * b[1]))]
    return ring
