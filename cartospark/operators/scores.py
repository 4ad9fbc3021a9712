"""Walkability and bikeability: weighted scores of what lies around a centre.

Each component is a one-row aggregate over elements within the radius; a way is
where its mean vertex is. The parts are cross-joined, one row each.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, units
from ..plans import tagexpr as T
from ..plans.model import GeoMap
from ..session import stored
from . import network, spatial


def center(m: GeoMap) -> tuple[float, float]:
    """Mean (lat, lon) of all node coordinates."""
    r = m.coords.agg(F.avg("lat").alias("y"), F.avg("lon").alias("x")).first()
    return r["y"], r["x"]


def _within(lat: float, lon: float, radius: float, x: Column = None, y: Column = None) -> Column:
    x, y = (F.col("lon") if x is None else x), (F.col("lat") if y is None else y)
    d_lat, d_lon = geo.box(radius * 1.01, lat)
    return y.between(lat - d_lat, lat + d_lat) & x.between(lon - d_lon, lon + d_lon) & (geo.haversine((F.lit(lon), F.lit(lat)), (x, y)) <= radius)


def _ways(m: GeoMap, lat: float, lon: float, radius: float) -> DataFrame:
    """Ways around the centre with n points, length and area."""
    c = F.col("coords")
    g = m.way_geometry().where(geo.let(F.struct(*geo.mean_point(c)), lambda p: _within(lat, lon, radius, p["col1"], p["col2"])))
    return g.select("id", "tags", F.size(c).alias("n"), geo.length(c, C.R_ROUND).alias("m"), geo.area(c).alias("a"))


def _lengths(rows: DataFrame, **parts: Column) -> DataFrame:
    return rows.agg(*(F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0.0)).alias(k) for k, c in parts.items()))


def _cross(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def walkability(m: GeoMap, lat: float | None = None, lon: float | None = None, radius: float = 1000.0) -> DataFrame:
    """One row: counts and lengths, six component scores, score and grade. The pedestrian share is of the whole map's walkable roads."""
    if lat is None or lon is None:
        lat, lon = center(m)
    t = F.col("tags")
    is_in = lambda key, vs: T.column(T.isin(key, vs), t)
    near = m.nodes.where(_within(lat, lon, radius))
    ways = _ways(m, lat, lon, radius)
    walk = network.edges(m, "walk", directed=False)
    halves = walk.agg((F.coalesce(F.sum("distance_m"), F.lit(0.0)) / 2).alias("walk_m"), (F.coalesce(F.sum(F.when(F.col("highway").isin(*C.PEDESTRIAN_WAYS), F.col("distance_m"))), F.lit(0.0)) / 2).alias("pedestrian_m"))
    degree = walk.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")).join(m.coords, "id").where(_within(lat, lon, radius))
    crossings = degree.agg(F.count_if(F.col("k") >= 3).alias("intersections"), F.count_if(F.col("k") == 1).alias("dead_ends"), F.count(F.lit(1)).alias("graph_nodes"), F.floor(F.coalesce(F.sum("k"), F.lit(0)) / 2).cast("long").alias("graph_edges"))
    kinds = _walk_kinds(t)
    amenities = near.agg(*(F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()), F.count_if(is_in("highway", ("crossing",))).alias("crossings"), F.count_if(is_in("highway", ("traffic_signals",))).alias("signals"), F.count_if(is_in("lit", ("yes",))).alias("lights"))
    green = _green(t)
    streets = is_in("highway", C.MODE_ROADS["walk"]) & (F.col("n") >= 2)
    sided = streets & ~is_in("highway", ("footway", "pedestrian", "path", "steps"))
    area = lambda c: F.coalesce(F.sum(F.when(c & (F.col("n") >= 3), F.col("a"))), F.lit(0.0))
    around = ways.agg(
        F.count_if(green).alias("greens"), area(green).alias("green_sqm"), F.count_if(is_in("highway", ("pedestrian",))).alias("zones"), area(is_in("highway", ("pedestrian",))).alias("zone_sqm"),
        F.count_if(T.column(T.has("building"), t)).alias("buildings"), area(T.column(T.has("building"), t)).alias("building_sqm"),
        F.coalesce(F.sum(F.when(sided, F.col("m"))), F.lit(0.0)).alias("sided_m"), F.coalesce(F.sum(F.when(sided & is_in("sidewalk", ("yes", "both", "left", "right", "separate")), F.col("m"))), F.lit(0.0)).alias("sidewalk_m"),
    )
    row = _cross([halves, crossings, amenities, around])
    return _walk_scored(row, radius)


def _walk_kinds(t: Column) -> dict[str, Column]:
    """Conditions on a node's tags by sort of amenity."""
    is_in = lambda key, vs: T.column(T.isin(key, vs), t)
    kinds = {k: is_in("amenity", v) | is_in("shop", v) | is_in("leisure", v) for k, v in C.WALK_AMENITIES.items()}
    kinds["transit"] = kinds["transit"] | is_in("public_transport", ("stop_position", "platform", "station")) | is_in("highway", ("bus_stop",))
    return kinds


def _green(t: Column) -> Column:
    return T.column(T.any_of(T.isin("leisure", ("park", "garden", "playground")), T.isin("landuse", ("grass", "forest"))), t)


def _walk_scored(row: DataFrame, radius: float) -> DataFrame:
    """Rows of counts around a centre with six component scores, score and grade."""
    km2 = 3.141592653589793 * (radius / 1000) ** 2
    capped = lambda c: F.least(F.lit(100.0), c.cast("double"))
    scores = {
        "pedestrian_infrastructure": capped(F.when(F.col("walk_m") > 0, F.col("pedestrian_m") / F.col("walk_m")).otherwise(0.0) * 200), "intersection_density": capped(F.col("intersections") / km2 / 1000 * 2000),
        "amenity_access": capped(sum((F.col(f"n_{k}") for k in C.WALK_AMENITIES if k != "transit"), F.lit(0)) * 5), "transit_access": capped(F.col("n_transit") * 20), "greenspace": capped(F.col("greens") * 20), "safety_features": capped((F.col("crossings") + F.col("signals")) * 10),
    }
    row = row.select("*", *(c.alias(k) for k, c in scores.items())).withColumn("score", sum((F.col(k) * w for k, w in C.WALK_WEIGHTS.items()), F.lit(0.0)))
    letter, words = units.grade(F.col("score"), C.WALK_GRADES)
    return row.withColumn("grade", letter).withColumn("grade_text", words)


def walkability_map(m: GeoMap, step: float = 500.0, radius: float = 1000.0, bounds: tuple[float, float, float, float] | None = None, cells: tuple[int, int] | None = None) -> DataFrame:
    """(cell_y, cell_x, lat, lon, counts, scores, grade): walkability around the middle of every cell of a grid, all cells at once.

    Cells are ``step`` metres high and, at the middle latitude of the bounds
    (south, west, north, east; the map's own if not given), as wide; or the
    bounds are cut into ``cells`` (rows, columns). Crossroads,
    nodes and green ways are points that count in every cell whose middle is
    within ``radius``; they are stored once, meet cells by proximity and are summed there. A
    cell's score is that of walkability() at its middle.
    """
    if bounds is None:
        r = m.coords.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
        bounds = tuple(r) if r[0] is not None else (0.0, 0.0, 0.0, 0.0)
    south, west, north, east = bounds
    d_lat, d_lon = geo.box(step, (south + north) / 2)
    if cells:
        (n_y, n_x), d_lat, d_lon = cells, (north - south) / cells[0], (east - west) / cells[1]
    else:
        n_y, n_x = (max(1, math.ceil((hi - lo) / d)) for lo, hi, d in ((south, north, d_lat), (west, east, d_lon)))
    grid = m.coords.sparkSession.range(n_y * n_x).select("id", F.floor(F.col("id") / n_x).alias("cell_y"), (F.col("id") % n_x).alias("cell_x"))
    grid = grid.withColumns({"lat": F.lit(south) + (F.col("cell_y") + 0.5) * d_lat, "lon": F.lit(west) + (F.col("cell_x") + 0.5) * d_lon})
    t = F.col("tags")
    is_in = lambda key, vs: T.column(T.isin(key, vs), t)
    walk = stored(network.edges(m, "walk", directed=False).select("src", "highway", "distance_m"))
    halves = walk.agg((F.coalesce(F.sum("distance_m"), F.lit(0.0)) / 2).alias("walk_m"), (F.coalesce(F.sum(F.when(F.col("highway").isin(*C.PEDESTRIAN_WAYS), F.col("distance_m"))), F.lit(0.0)) / 2).alias("pedestrian_m"))
    kinds = _walk_kinds(t)
    names = ["intersections", *(f"n_{k}" for k in kinds), "crossings", "signals", "greens"]

    def events(rows: DataFrame, **counts: Column) -> DataFrame:
        counts = {k: c.cast("long") for k, c in counts.items()}
        full = rows.select("lat", "lon", *(F.coalesce(counts.get(k, F.lit(0)), F.lit(0)).cast("long").alias(k) for k in names))
        return full.where(sum((F.col(k) for k in counts), F.lit(0)) > 0)

    x, y = geo.mean_point(F.col("coords"))
    crossroads = walk.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")).join(m.coords, "id")
    found = events(crossroads, intersections=F.col("k") >= 3)
    found = found.unionByName(events(m.nodes, **{f"n_{k}": c for k, c in kinds.items()}, crossings=is_in("highway", ("crossing",)), signals=is_in("highway", ("traffic_signals",))))
    green = m.ways.where(_green(t))
    lines = m.with_(ways=green, refs=m.way_refs().join(green.select(F.col("id").alias("way_id")), "way_id", "left_semi")).way_geometry()
    found = stored(found.unionByName(events(lines.select(y.alias("lat"), x.alias("lon")), greens=F.lit(True))))
    met = spatial.within_distance(found, grid.select("id", "lat", "lon"), radius)
    sums = met.groupBy(F.col("r_id").alias("id")).agg(*(F.sum(f"l_{k}").alias(k) for k in names))
    rows = grid.join(sums, "id", "left").fillna(0, names).crossJoin(F.broadcast(halves))  # one row
    return _walk_scored(rows, radius).drop("id")


def bike_car_nodes(m: GeoMap, lat: float, lon: float, radius: float) -> DataFrame:
    """(id): nodes around a centre on both a bike way and a car road, as a semi join of the two node sets."""
    t = F.col("tags")
    bike = T.column(T.any_of(T.eq("highway", "cycleway"), T.eq("bicycle_road", "yes"), T.isin("cycleway", C.BIKE_LANES), T.isin("bicycle", ("designated", "yes"))), t)
    car = t["highway"].isin(*(k for k, v in C.CAR_DANGER.items() if v >= 25))
    nodes = lambda where: m.way_refs().join(m.ways.where(F.map_contains_key("tags", F.lit("highway")) & where).select(F.col("id").alias("way_id")), "way_id", "left_semi").select(F.col("ref").alias("id")).distinct()
    return nodes(bike).join(nodes(car), "id", "left_semi").join(m.coords.where(_within(lat, lon, radius)), "id").select("id")


def bike_intersections(m: GeoMap, lat: float, lon: float, radius: float) -> DataFrame:
    """(id, danger, has_signals, safety_score): nodes where a bike way meets a car road (danger 25 or more); signals count within 25 m."""
    t = F.col("tags")
    danger = F.create_map(*(x for k, v in C.CAR_DANGER.items() for x in (F.lit(k), F.lit(v))))
    bike = T.column(T.any_of(T.isin("highway", ("cycleway", "path")), T.eq("bicycle_road", "yes"), T.isin("cycleway", C.BIKE_LANES), T.isin("bicycle", ("designated", "yes"))), t)
    roads = m.ways.where(F.map_contains_key("tags", F.lit("highway"))).select(F.col("id").alias("way_id"), bike.alias("bike"), F.coalesce(F.element_at(danger, t["highway"]), F.lit(0)).alias("d"))
    met = m.way_refs().join(roads, "way_id").groupBy(F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.bool_or("bike").alias("bike"), F.max(F.when(F.col("d") >= 25, F.col("d"))).alias("danger")).where("k >= 2 and bike and danger is not null")
    met = stored(met.join(m.coords, "id").where(_within(lat, lon, radius)))
    near = m.nodes.where(_within(lat, lon, radius))
    flags = near.select("id", T.column(T.eq("crossing:island", "yes"), t).alias("island"), T.column(T.isin("crossing", ("marked", "zebra", "controlled")), t).alias("marked"), T.column(T.any_of(T.eq("crossing", "traffic_signals"), T.all_of(T.eq("crossing:signals", "yes"), T.any_of(T.eq("crossing:island", "yes"), T.all_of(T.eq("highway", "crossing"), T.isin("bicycle", ("yes", "designated")))))), t).alias("own"), T.column(T.any_of(T.all_of(T.eq("highway", "crossing"), T.isin("bicycle", ("yes", "designated"))), T.eq("crossing", "traffic_signals"), T.eq("crossing:island", "yes")), t).alias("is"))
    signals = near.where(T.column(T.any_of(T.eq("highway", "traffic_signals"), T.eq("crossing", "traffic_signals")), t)).select("id", "lat", "lon")
    signals = stored(signals)
    close = spatial.within_distance(met.select("id", "lat", "lon"), signals, 25.0).select(F.col("l_id").alias("id")).distinct().withColumn("close", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)) & F.coalesce(F.col("is"), F.lit(False))
    has = no("own") | F.coalesce(F.col("close"), F.lit(False))
    rows = met.join(flags, "id", "left").join(close, "id", "left")
    score = 100 - F.col("danger") + F.when(has, 40).otherwise(0) + F.when(no("island"), 20).otherwise(0) + F.when(no("marked"), 10).otherwise(0)
    return rows.select("id", "danger", has.alias("has_signals"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("safety_score"))


def bikeability(m: GeoMap, lat: float | None = None, lon: float | None = None, radius: float = 1000.0) -> DataFrame:
    """One row: lengths, facilities, barriers, parking, traffic context, connectivity, intersections; eight component scores, score and grade."""
    if lat is None or lon is None:
        lat, lon = center(m)
    t = F.col("tags")
    is_road = F.map_contains_key("tags", F.lit("highway"))
    metres = F.when(is_road, F.col("m"))
    is_in = lambda key, *vs: T.column(T.isin(key, vs), t)
    table = lambda d, key, other: F.coalesce(F.element_at(F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v)))), t[key]), F.lit(other))
    near = m.nodes.where(_within(lat, lon, radius))
    around = _ways(m, lat, lon, radius).where("n >= 2")
    total = lambda c, k: F.coalesce(F.sum(c), F.lit(0.0)).alias(k)
    on = lambda cond, k=1.0: F.when(cond, metres * k).otherwise(0.0)
    lane = {s: is_in(f"cycleway{s}", *C.BIKE_LANES) for s in ("", ":left", ":right", ":both")}
    against = {s: lane[s] & F.coalesce(t[f"cycleway{s}"].contains("opposite"), F.lit(False)) for s in lane}
    sides = lane[":left"] | lane[":right"]
    by_lane = lambda d: F.when(lane[":both"], on(d[":both"], 2.0)).when(sides, on(d[":left"]) + on(d[":right"])).otherwise(on(d[""]))
    infra = is_in("highway", "cycleway") | lane[""] | sides | lane[":both"]
    lanes = by_lane(lane) + on(is_in("bicycle", "yes", "designated", "official") & ~infra, 0.3) + on(is_in("highway", "footway") & is_in("bicycle", "yes", "designated") & ~infra, 0.5)
    kept_apart = T.first(T.tag("cycleway:separation"), T.tag("cycleway:left:separation"), T.tag("cycleway:right:separation"))
    apart = is_in("highway", "cycleway") | is_in("segregated", "yes") | F.coalesce(T.column(kept_apart, t).isin("kerb", "bollard", "fence", "vertical_panel"), F.lit(False))
    speed = F.when(t["maxspeed"].contains("mph"), F.trim(F.replace(t["maxspeed"], F.lit("mph"), F.lit(""))).try_cast("int") * 1.6).otherwise(F.trim(F.replace(t["maxspeed"], F.lit("km/h"), F.lit(""))).try_cast("int"))
    has_bus = T.column(T.any_of(T.has("busway"), T.has("lanes:bus"), T.has("lanes:psv")), t)
    trucks = F.map_contains_key("tags", F.lit("hgv")) & ~is_in("hgv", "no")
    one = is_in("oneway", "yes")
    exempt = one & (is_in("oneway:bicycle", "no") | F.coalesce(t["cycleway"].contains("opposite"), F.lit(False)))
    lengths = around.agg(
        total(metres, "total_m"), total(on(is_in("highway", "cycleway")), "cycleway_m"), total(lanes, "lane_m"), total(on(is_in("bicycle_road", "yes", "designated") | is_in("cyclestreet", "yes")), "bike_road_m"), total(on(apart), "separated_m"),
        total(by_lane(against) + on(one & is_in("oneway:bicycle", "no")), "contraflow_m"), total(on(is_in("highway", "living_street", "residential", "pedestrian", "path")), "low_traffic_m"),
        total(on(F.map_contains_key("tags", F.lit("surface"))), "surface_m"), total(F.when(F.map_contains_key("tags", F.lit("surface")), metres * table(C.SURFACE_SCORES, "surface", 50)).otherwise(0.0), "surface_weighted"),
        total(on(F.coalesce(speed <= 30, F.lit(False))), "slow_m"), total(on(speed.isNotNull()), "speed_m"), total(on(has_bus & is_in("bicycle", "yes", "designated")), "busway_m"), total(on(trucks), "hgv_m"), total(F.when(trucks, metres * table(C.HGV_DANGER, "hgv", 40)).otherwise(0.0), "hgv_weighted"),
        total(on(one), "oneway_m"), F.count_if(is_road & exempt).alias("exemptions"), total(on(exempt), "exempt_m"),
        F.count_if(F.map_contains_key("tags", F.lit("barrier"))).alias("way_barriers"), F.count_if(is_in("bicycle", "dismount")).alias("dismounts"), total(F.when(is_in("bicycle", "dismount"), F.col("m")), "dismount_m"),
    )
    capacity = F.coalesce(F.trim(t["capacity"]).try_cast("int"), F.lit(10))
    parks = is_in("amenity", "bicycle_parking")
    quality = F.greatest(F.lit(0), F.least(F.lit(100), table(C.PARKING_SCORES, "bicycle_parking", 50) + F.when(is_in("covered", "yes"), 15).otherwise(0) + F.when(is_in("surveillance", "yes", "cctv", "guard"), 10).otherwise(0) - F.when(is_in("access", "private"), 20).otherwise(0) - F.when(is_in("fee", "yes"), 5).otherwise(0)))
    points = near.agg(
        F.count_if(parks).alias("parking"), F.count_if(is_in("amenity", "bicycle_rental")).alias("rental"), F.count_if(is_in("amenity", "bicycle_repair_station")).alias("repair"), F.count_if(is_in("amenity", "compressed_air")).alias("pumps"), F.count_if(is_in("shop", "bicycle")).alias("bike_shops"),
        F.coalesce(F.sum(F.when(parks, capacity)), F.lit(0)).alias("capacity"), F.coalesce(F.sum(F.when(parks & is_in("covered", "yes"), capacity)), F.lit(0)).alias("covered_capacity"), F.coalesce(F.sum(F.when(parks, quality * capacity)), F.lit(0)).alias("quality_sum"),
        F.count_if(is_in("amenity", "drinking_water")).alias("water"), F.count_if(is_in("amenity", "toilets")).alias("toilets"), F.count_if(is_in("amenity", "bench")).alias("benches"), F.count_if(is_in("amenity", "shelter")).alias("shelters"),
        F.count_if(F.map_contains_key("tags", F.lit("barrier"))).alias("node_barriers"), F.coalesce(F.sum(F.when(F.map_contains_key("tags", F.lit("barrier")), table(C.BARRIER_PENALTIES, "barrier", 20))), F.lit(0)).alias("barrier_penalty"),
        F.coalesce(F.sum(F.when(F.map_contains_key("tags", F.lit("kerb")), table(C.KERB_PENALTIES, "kerb", 20))), F.lit(0)).alias("kerb_penalty"), F.count_if(is_in("highway", "crossing")).alias("crossings"), F.count_if(is_in("highway", "traffic_signals")).alias("signals"),
    )
    rideable = tuple(k for k, v in C.BIKE_ROADS.items() if v >= 20)
    seg = stored(spatial.segments(m, strict=True, ways=m.ways.where(is_in("highway", *rideable))).select("src", "dst"))
    inside = m.coords.where(_within(lat, lon, radius)).select("id")
    links = seg.select("src", "dst").join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    parts = network.components(links).groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("components"))
    nodes = seg.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(inside, "id", "left_semi").agg(F.count(F.lit(1)).alias("bike_nodes"))
    meets = bike_intersections(m, lat, lon, radius).agg(F.count(F.lit(1)).alias("meets"), F.count_if(F.col("safety_score") >= 60).alias("safe_meets"), F.coalesce(F.avg("safety_score"), F.lit(70.0)).alias("meet_safety"))
    row = _cross([lengths, points, parts, nodes, meets])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    capped = lambda c, top=100.0: F.least(F.lit(top), c.cast("double"))
    row = row.withColumn("_all", F.col("cycleway_m") + F.col("lane_m") + F.col("bike_road_m"))
    slow = F.when(F.col("speed_m") > 0, F.col("slow_m") / F.col("speed_m")).otherwise(0.3)
    scores = {
        "dedicated_infrastructure": F.when(F.col("total_m") > 0, capped(ratio("_all", "total_m") * 400 + capped(ratio("contraflow_m", "total_m") * 100, 10.0))).otherwise(0.0), "intersection_safety": F.col("meet_safety"),
        "road_quality": F.when(F.col("surface_m") > 0, F.col("surface_weighted") / F.col("surface_m")).otherwise(50.0), "network_connectivity": capped(ratio("largest", "bike_nodes") * 120), "traffic_separation": capped(ratio("separated_m", "total_m") * 500),
        "bike_facilities": capped(F.col("parking") * 10, 50.0) + capped(F.col("rental") * 15, 30.0) + capped(F.col("repair") * 10 + F.col("bike_shops") * 5 + F.col("pumps") * 5, 20.0),
        "traffic_calming": F.when(F.col("total_m") > 0, capped((ratio("low_traffic_m", "total_m") + slow) * 100)).otherwise(0.0), "topography": F.lit(70.0),
    }
    row = row.select("*", *(c.alias(k) for k, c in scores.items())).drop("_all").withColumn("score", sum((F.col(k) * w for k, w in C.BIKE_WEIGHTS.items()), F.lit(0.0)))
    letter, words = units.grade(F.col("score"), C.BIKE_GRADES)
    return row.withColumn("grade", letter).withColumn("grade_text", words)
