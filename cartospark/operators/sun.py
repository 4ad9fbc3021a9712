"""Sun study: where the sun stands, the shadows that buildings cast, and the points that lie in them.

All of it is built-in column functions; Spark reads, shuffles and joins rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import M_PER_DEG
from ..functions import geo
from ..plans import features
from ..plans.model import GeoMap


def _number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def declination(day: Column | int) -> Column:
    """Degrees of the sun's declination on a day of the year (from 1), by Cooper's formula."""
    return 23.45 * F.sin(2.0 * F.pi() * (284 + _number(day)) / 365)


def position(lat: Column | float, day: Column | int, hour: Column | float) -> tuple[Column, Column]:
    """(altitude, azimuth) in degrees at a solar hour; azimuth from north by east, 180 where it is not defined (the poles, the zenith)."""
    lat, hour = F.radians(_number(lat)), _number(hour)
    dec = F.radians(declination(day))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(F.radians((hour - 12) * 15))))
    across = F.cos(lat) * F.sqrt(1 - sine * sine)
    cosine = F.when(across > 1e-12, (F.sin(dec) - F.sin(lat) * sine) / across).otherwise(F.lit(-1.0))
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.degrees(F.asin(sine)), F.when(hour > 12, 360 - half).otherwise(half)


def hull(points: Column) -> Column:
    """Convex hull of an array of (lon, lat), closed and counter-clockwise, from the least point on.

    Points come in order of (lon, lat). Those of a chain that a new point puts
    inside are its last ones, so they are filtered out rather than popped.
    """

    def chain(p: Column) -> Column:
        cross = lambda a, b, c: (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])
        return F.aggregate(p, F.slice(p, 1, 0), lambda s, c: F.concat(F.filter(s, lambda b, i: (i == 0) | (cross(F.get(s, i - 1), b, c) > 0)), F.array(c)))

    p = F.array_sort(F.array_distinct(points))
    lower, upper = chain(p), chain(F.reverse(p))
    return F.when(F.size(p) < 3, F.concat(p, F.slice(p, 1, 1))).otherwise(F.concat(lower, F.slice(upper, 2, F.size(upper))))


def shadows(m: GeoMap, day: int, hours: tuple[float, ...] = (12.0,)) -> DataFrame:
    """(id, hour, height_m, altitude, azimuth, length_m, ring, east, north, outline, area_sqm): every building's shadow on level ground at each hour with sun.

    ``east`` and ``north`` are degrees from a corner to its shadow; ``outline`` is
    the hull of the ring and its shifted copy (the shadow itself if the building
    is convex), ``area_sqm`` its area. Buildings without height tags get the
    height drawn for their kind; hours without sun have no rows.
    """
    t, c = F.col("tags"), F.col("ring")
    rows = m.way_geometry().where(F.map_contains_key(t, F.lit("building")) & (F.size("coords") >= 3))
    rows = rows.select("id", features.estimated_height(t).alias("height_m"), geo.closed(F.col("coords")).alias("ring"), geo.mean_point(F.col("coords"))[1].alias("lat"))
    rows = rows.withColumn("hour", F.explode(F.array(*(F.lit(float(h)) for h in hours))))
    altitude, azimuth = position(F.col("lat"), day, F.col("hour"))
    rows = rows.withColumns({"altitude": altitude, "azimuth": azimuth}).where("altitude > 0 and height_m > 0")
    rows = rows.withColumn("length_m", F.col("height_m") / F.tan(F.radians("altitude")))
    away = F.radians(F.col("azimuth") + 180)
    rows = rows.withColumns({"east": F.col("length_m") * F.sin(away) / (M_PER_DEG * F.cos(F.radians("lat"))), "north": F.col("length_m") * F.cos(away) / M_PER_DEG})
    moved = F.transform(c, lambda p: F.struct((p["lon"] + F.col("east")).alias("lon"), (p["lat"] + F.col("north")).alias("lat")))
    rows = rows.withColumn("outline", hull(F.concat(c, moved)))
    area = F.abs(geo.signed_area(F.col("outline"))) * (M_PER_DEG * M_PER_DEG) * F.cos(F.radians("lat"))
    return rows.select("id", "hour", "height_m", "altitude", "azimuth", "length_m", "ring", "east", "north", "outline", area.alias("area_sqm"))


def is_shaded(p: tuple[Column, Column], ring: Column, east: Column, north: Column) -> Column:
    """Whether a point lies in the shadow of a building, dented ones included: in its ring, or with a wall between it and the sun."""
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    qx, qy = p[0] - east, p[1] - north  # where the ray to the sun leaves the roof's height

    def wall(e: Column) -> Column:
        a, b = geo.lonlat(e["a"]), geo.lonlat(e["b"])
        return (side(*a, *b, *p) * side(*a, *b, qx, qy) <= 0) & (side(*p, qx, qy, *a) * side(*p, qx, qy, *b) <= 0)

    return geo.in_ring_column(p, ring) | F.exists(geo.pairs(ring), wall)


def shaded(points: DataFrame, shadow: DataFrame, cell: float = 0.002) -> DataFrame:
    """(id, hour, n): points with a shadow at an hour, and how many buildings cast one there.

    Points meet the cells (``cell`` degrees) of a shadow's own box by equi-join; ids tell points apart.
    """
    lons, lats = F.transform("outline", lambda p: p["lon"]), F.transform("outline", lambda p: p["lat"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    cast = shadow.select("hour", "ring", "east", "north", F.explode(span(lons)).alias("cx"), span(lats).alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    at = points.select("id", "lon", "lat", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    met = at.join(cast, ["cx", "cy"]).where(is_shaded((F.col("lon"), F.col("lat")), F.col("ring"), F.col("east"), F.col("north")))
    return met.groupBy("id", "hour").agg(F.count(F.lit(1)).alias("n"))
