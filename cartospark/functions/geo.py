"""Geometry as Column builders: points are lon/lat columns, lines and rings are array<struct<lon, lat>>.

All of it is built-in expressions; nothing leaves the JVM. Angles in degrees,
lengths in metres. The Earth radius and the degree length are parameters,
because the operators that use these functions do not share one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import M_PER_DEG, R_MEAN, R_ROUND

Point = tuple[Column, Column]


def lonlat(c: Column) -> Point:
    return c["lon"], c["lat"]


def haversine(a: Point, b: Point, radius: float = R_ROUND) -> Column:
    """Great-circle distance of two (lon, lat) points, clamped against rounding above the antipode."""
    d_lat, d_lon = F.radians(b[1] - a[1]) / 2, F.radians(b[0] - a[0]) / 2
    h = F.pow(F.sin(d_lat), F.lit(2.0)) + F.cos(F.radians(a[1])) * F.cos(F.radians(b[1])) * F.pow(F.sin(d_lon), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(a: Point, b: Point) -> Column:
    """Initial bearing from a to b in [0, 360)."""
    la, lb, d = F.radians(a[1]), F.radians(b[1]), F.radians(b[0] - a[0])
    y, x = F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once a row, however often f names it: a lambda's argument is no copy of its expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def pairs(c: Column) -> Column:
    """Consecutive pairs of a line, as array<struct<a, b>>; none below two points."""
    near = lambda v, n: F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    return let(c, lambda v: near(v, F.greatest(F.size(v) - 1, F.lit(0))))


def measured(c: Column, radius: float = R_ROUND) -> Column:
    """pairs() with the length of each, as array<struct<a, b, d>>."""
    return F.transform(pairs(c), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), haversine(lonlat(p["a"]), lonlat(p["b"]), radius).alias("d")))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + term(x))


def length(c: Column, radius: float = R_ROUND) -> Column:
    """Length of a line; 0 below two points."""
    return _sum(pairs(c), lambda p: haversine(lonlat(p["a"]), lonlat(p["b"]), radius))


def straight(c: Column, radius: float = R_MEAN) -> Column:
    """Distance of a line's ends; 0 below two points."""
    return F.when(F.size(c) < 2, 0.0).otherwise(haversine(lonlat(F.element_at(c, 1)), lonlat(F.element_at(c, -1)), radius))


def sinuosity(c: Column, radius: float = R_MEAN) -> Column:
    """Length over straight distance; 1 below two points or for ends that nearly meet."""
    d = straight(c, radius)
    return F.when((F.size(c) < 2) | (d < 0.001), 1.0).otherwise(length(c, radius) / d)


def line_bearing(c: Column) -> Column:
    """Bearing from first to last point; 0 below two points."""
    return F.when(F.size(c) < 2, 0.0).otherwise(bearing(lonlat(F.element_at(c, 1)), lonlat(F.element_at(c, -1))))


def midpoint(c: Column, radius: float = R_MEAN) -> Column:
    """struct<lon, lat> half-way along a line by length; the middle vertex if it has no length. Each segment is measured once."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    middle = F.element_at(c, (F.floor(F.size(c) / 2) + 1).cast("int"))

    def step(s: Column, p: Column, half: Column) -> Column:
        t = F.when(p["d"] > 0, (half - s["run"]) / p["d"]).otherwise(0.0)
        hit = s["lon"].isNull() & (s["run"] + p["d"] >= half)
        at = lambda k: F.when(hit, p["a"][k] + t * (p["b"][k] - p["a"][k])).otherwise(s[k])
        return F.struct((s["run"] + p["d"]).alias("run"), at("lon").alias("lon"), at("lat").alias("lat"))

    def found(items: Column, half: Column) -> Column:
        pick = lambda q, k: F.when((half > 0) & q["lon"].isNotNull(), q[k]).otherwise(middle[k]).alias(k)
        return let(F.aggregate(items, start, lambda s, p: step(s, p, half)), lambda q: F.struct(pick(q, "lon"), pick(q, "lat")))

    half_of = lambda items: _sum(items, lambda p: p["d"]) / 2
    return F.when(F.size(c) > 0, let(measured(c, radius), lambda items: let(half_of(items), lambda half: found(items, half))))


def _ring_pairs(c: Column) -> Column:
    """Pairs of a ring with the closing edge."""
    turned = lambda v: F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    return let(c, lambda v: F.zip_with(v, turned(v), lambda p, q: F.struct(p.alias("a"), q.alias("b"))))


def mean_point(c: Column) -> Point:
    """Mean of a line's vertices (a repeated closing vertex counts twice); null for none."""
    n = F.size(c)
    return tuple(F.when(n > 0, _sum(c, lambda p, k=k: p[k]) / n) for k in ("lon", "lat"))


def signed_area(c: Column) -> Column:
    """Shoelace sum in square degrees, positive for counter-clockwise."""
    return _sum(_ring_pairs(c), lambda p: p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"]) / 2


def area(c: Column) -> Column:
    """Area in square metres on a plane at the vertices' mean latitude; 0 below three points."""
    _, lat = mean_point(c)
    return F.when(F.size(c) < 3, 0.0).otherwise(F.abs(signed_area(c)) * M_PER_DEG * M_PER_DEG * F.cos(F.radians(lat)))


def area_spherical(c: Column, radius: float = R_ROUND) -> Column:
    """Area by the same rule with the degree length of a sphere of this radius."""
    _, lat = mean_point(c)
    return F.when(F.size(c) < 3, 0.0).otherwise(F.abs(F.radians(F.radians(signed_area(c)))) * radius * radius * F.cos(F.radians(lat)))


def is_ccw(c: Column) -> Column:
    return signed_area(c) > 0


def wound(c: Column, ccw: bool) -> Column:
    """A ring turned to the given winding; below three points as it is."""
    return F.when((F.size(c) >= 3) & (is_ccw(c) != F.lit(ccw)), F.reverse(c)).otherwise(c)


def closed(c: Column) -> Column:
    """A ring that ends where it starts."""
    first, last = F.element_at(c, 1), F.element_at(c, -1)
    return F.when((F.size(c) > 0) & (first != last), F.concat(c, F.array(first))).otherwise(c)


def in_ring(p: Point, ring: list[tuple[float, float]], half_open: bool = True) -> Column:
    """Whether a point lies in a constant ring, by crossings of a ray to the east.

    half_open counts an edge if exactly one end is above the point. The other
    convention takes min(y) < lat <= max(y) and lon <= max(x), vertical edges
    always crossing.
    """
    lon, lat = p
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        x = (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1
        if half_open:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < x)
        else:
            hit = (lat > min(y1, y2)) & (lat <= max(y1, y2)) & (lon <= max(x1, x2)) & (F.lit(x1 == x2) | (lon <= x))
        crossings = crossings + F.when(hit, 1).otherwise(0)
    return crossings % 2 == 1


def in_ring_column(p: Point, ring: Column) -> Column:
    """The half-open rule for a ring column."""
    lon, lat = p

    def hit(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < x), F.lit(False))

    return F.aggregate(_ring_pairs(ring), F.lit(False), lambda s, e: s != hit(e))


def on_segment(p: Point, a: Point, b: Point) -> Point:
    """The point of segment a-b nearest to p, on the plane of degrees."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))).otherwise(0.0)
    return a[0] + t * dx, a[1] + t * dy


def circle(p: Point, metres: Column | float, n: int = 32) -> Column:
    """A closed ring of n + 1 points around p, an ellipse in degrees."""
    lon, lat = p
    r = metres if isinstance(metres, Column) else F.lit(float(metres))
    r_lat, r_lon = r / M_PER_DEG, r / (M_PER_DEG * F.cos(F.radians(lat)))
    turn = lambda i: F.lit(2.0) * F.pi() * (i % n) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((lon + r_lon * F.cos(turn(i))).alias("lon"), (lat + r_lat * F.sin(turn(i))).alias("lat")))


def densified(c: Column, interval: float, radius: float = R_ROUND) -> Column:
    """A line with every segment cut into ceil(length / interval) equal parts."""

    def parts(s: Column) -> Column:
        along = lambda i, n, k: s["a"][k] + (s["b"][k] - s["a"][k]) * i / n
        n = F.greatest(F.lit(1), F.ceil(haversine(lonlat(s["a"]), lonlat(s["b"]), radius) / interval).cast("int"))
        return let(n, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(along(i, n, "lon").alias("lon"), along(i, n, "lat").alias("lat"))))

    return F.when(F.size(c) < 2, c).otherwise(F.concat(F.flatten(F.transform(pairs(c), parts)), F.slice(c, -1, 1)))


def box(metres: float, lat: float) -> tuple[float, float]:
    """(degrees of latitude, degrees of longitude) that cover a distance at a latitude."""
    import math

    return metres / M_PER_DEG, metres / (M_PER_DEG * max(1e-9, math.cos(math.radians(lat))))
