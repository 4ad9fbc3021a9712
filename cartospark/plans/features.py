"""Feature extraction as data: a specification names what qualifies and what is derived; one function runs it.

Every extraction has the same shape: elements whose tags qualify, a kind and a
category, some tags as columns, a position (the node, or the mean of a way's
resolved vertices) and, for ways, a measure. ``extract`` turns a specification
into one DataFrame; nothing is extracted twice for two specifications.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, units
from . import tagexpr as T
from .filters import infra_type
from .model import GeoMap, is_closed


@dataclass(frozen=True)
class Spec:
    """``where`` qualifies an element, ``node_where``/``way_where`` further restrict one sort (None: that sort is left out)."""

    name: str
    where: T.Expr
    kind: T.Expr
    category: T.Expr = ("lit", None)
    node_where: T.Expr | None = ("has", "*")
    way_where: T.Expr | None = ("has", "*")
    min_coords: int = 1
    length: bool = False
    area: str | None = None  # "plane", "sphere": of ways with three points or more
    area_if_closed: bool = False
    columns: dict[str, T.Expr] = field(default_factory=dict)


ANY: T.Expr = ("has", "*")


def _spec(name: str, where: T.Expr, kind: T.Expr, category: T.Expr = ("lit", None), **kw) -> Spec:
    return Spec(name, where, kind, category, **kw)


def _single(name: str, key: str, groups: dict | None = None, **kw) -> Spec:
    """Any value of one key, categories by value."""
    return _spec(name, T.has(key), T.tag(key), T.category(key, groups) if groups else ("lit", None), **kw)


_contact = {"phone": T.first(T.tag("phone"), T.tag("contact:phone")), "website": T.first(T.tag("website"), T.tag("contact:website"))}
_poi_hit = [(T.any_of(*(T.isin(k, v) for k, v in keys.items())), T.lit(name)) for name, keys in C.POI.items()]
_catch_hit = [(T.any_of(*((T.has(k) if v == ("*",) else T.isin(k, v)) for k, v in keys.items())), T.lit(name)) for name, keys in C.CATCHMENT.items()]
_health_kind = T.case((T.has("healthcare"), T.tag("healthcare")), default=T.tag("amenity"))
_health_cat = T.case(*((T.any_of(T.isin("healthcare", v), T.all_of(T.no(T.has("healthcare")), T.isin("amenity", v))), T.lit(k)) for k, v in C.HEALTHCARE.items()), default=T.lit("other"))
_emerg_kind = T.case((T.has("emergency"), T.tag("emergency")), default=T.tag("amenity"))
_emerg_cat = T.case(*((T.any_of(T.isin("emergency", v), T.all_of(T.no(T.has("emergency")), T.isin("amenity", v))), T.lit(k)) for k, v in C.EMERGENCY.items()), default=T.lit("other"))
_water_hit = [(T.isin(k, v), T.tag(k)) for k, v in C.WATER.items()]
_name_hit = [((T.has(k) if v is None else T.isin(k, v)), k) for k, v in C.NAME_KEYS]

SPECS: dict[str, Spec] = {
    s.name: s
    for s in (
        _spec("amenities", T.isin("amenity", T.union(C.AMENITY_GROUPS)), T.tag("amenity"), T.category("amenity", C.AMENITY_GROUPS), way_where=None),
        _spec("highways", T.isin("highway", T.union(C.HIGHWAY_GROUPS)), T.tag("highway"), T.category("highway", C.HIGHWAY_GROUPS), node_where=None, min_coords=2),
        _spec("building_shapes", T.isin("building", T.union(C.BUILDING_GROUPS)), T.tag("building"), T.category("building", C.BUILDING_GROUPS), node_where=None, min_coords=3, area="plane"),
        _spec("poi", T.any_of(*(w for w, _ in _poi_hit)), T.first(*(T.tag(k) for k in ("amenity", "shop", "healthcare", "highway", "railway", "aeroway", "tourism", "leisure", "office"))), T.case(*_poi_hit), min_coords=2, columns=_contact),
        _single("amenity", "amenity", C.AMENITY),
        _single("shop", "shop", C.SHOP, columns={"brand": T.tag("brand"), "opening_hours": T.tag("opening_hours")}),
        _spec("food", T.isin("amenity", C.FOOD), T.tag("amenity"), columns={"cuisine": T.tag("cuisine"), "takeaway": T.tag("takeaway"), "delivery": T.tag("delivery"), "outdoor_seating": T.tag("outdoor_seating")}),
        _spec("healthcare", T.any_of(T.has("healthcare"), T.isin("amenity", C.HEALTHCARE_AMENITY)), _health_kind, _health_cat, columns={"emergency": T.tag("emergency"), "speciality": T.first(T.tag("healthcare:speciality"), T.tag("speciality"))}),
        _spec("education", T.isin("amenity", C.EDUCATION_AMENITY), T.tag("amenity"), T.category("amenity", C.EDUCATION), columns={"capacity": T.tag("capacity"), "operator": T.tag("operator")}),
        _single("tourism", "tourism", C.TOURISM, columns={"stars": T.tag("stars")}),
        _single("leisure", "leisure", C.LEISURE, area="sphere", area_if_closed=True),
        _single("natural", "natural", C.NATURAL, columns={"ele": T.tag("ele")}),
        _spec("water", T.any_of(*(w for w, _ in _water_hit)), T.case(*_water_hit), T.case(*((w, T.lit(k)) for (w, _), k in zip(_water_hit, C.WATER, strict=True))), min_coords=2, area="plane", area_if_closed=True),
        _single("landuse", "landuse", C.LANDUSE, node_where=None, min_coords=3, area="plane"),
        _spec("trees", T.isin("natural", ("tree", "tree_row", "wood")), T.tag("natural"), node_where=T.eq("natural", "tree"), way_where=T.isin("natural", ("tree_row", "wood")), min_coords=2, columns={"species": T.first(T.tag("species"), T.tag("taxon"))}),
        _spec("parking", T.eq("amenity", "parking"), T.first(T.tag("parking"), T.lit("surface")), min_coords=3, area="plane", columns={"capacity": T.tag("capacity"), "fee": T.tag("fee")}),
        _spec("transit", T.any_of(*(T.eq(k, v) for k, v, _, _ in C.TRANSIT)), T.case(*((T.eq(k, v), T.lit(t)) for k, v, t, _ in C.TRANSIT)), T.case(*((T.eq(k, v), T.lit(f)) for k, v, _, f in C.TRANSIT))),
        _spec("railway", T.any_of(T.isin("railway", C.RAIL_LINES), T.isin("railway", C.RAIL_STATIONS)), T.tag("railway"), node_where=T.isin("railway", C.RAIL_STATIONS), way_where=T.isin("railway", C.RAIL_LINES), min_coords=2, length=True),
        _single("power", "power", length=True),
        _spec("historic", T.any_of(T.has("historic"), T.has("heritage")), T.first(T.tag("historic"), T.lit("heritage_site")), T.category("historic", C.HISTORIC), columns={"date": T.first(T.tag("start_date"), T.tag("historic:date")), "heritage": T.first(T.tag("heritage"), T.tag("heritage:operator"))}),
        _spec("emergency", T.any_of(T.has("emergency"), T.isin("amenity", ("hospital", "clinic", "police", "fire_station", "pharmacy"))), _emerg_kind, _emerg_cat, columns={"source_tag": T.case((T.has("emergency"), T.lit("emergency")), default=T.lit("amenity"))}),
        _single("barrier", "barrier", C.BARRIER, length=True),
        _spec("boundary", T.any_of(T.eq("boundary", "administrative"), T.has("admin_level")), T.first(T.tag("boundary"), T.lit("administrative")), T.case(*((T.eq("admin_level", k), T.lit(v)) for k, v in C.ADMIN_LEVELS.items()), default=T.lit("unknown")), node_where=None, min_coords=3, columns={"admin_level": T.tag("admin_level")}),
        _spec("sport", T.any_of(T.has("sport"), T.isin("leisure", ("pitch", "sports_centre", "stadium", "track", "swimming_pool", "golf_course", "fitness_centre"))), T.first(T.tag("sport"), T.tag("leisure")), T.category("sport", C.SPORT), area="sphere", area_if_closed=True),
        _spec("surface", T.has("highway"), T.first(T.tag("surface"), T.lit("unknown")), T.case(*((T.isin("surface", v), T.lit(k)) for k, v in C.SURFACES.items()), (T.has("surface"), T.lit("other")), default=T.lit("unknown")), node_where=None, min_coords=2, length=True),
        _spec("address", T.prefix("addr:"), T.case((T.all_of(T.has("addr:street"), T.has("addr:housenumber")), T.lit("complete")), default=T.lit("partial")), columns={k: T.tag(f"addr:{k}") for k in C.ADDRESS_KEYS}),
        _spec("names", T.has("name"), T.case(*((w, T.tag(k)) for w, k in _name_hit), default=T.lit("unknown")), T.case(*((w, T.lit(k)) for w, k in _name_hit), default=T.lit("other"))),
        _spec("catchment_poi", T.any_of(*(w for w, _ in _catch_hit)), T.case(*_catch_hit), way_where=None),
    )
}


def _measured(spec: Spec, c: Column, refs: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if spec.length:
        out["length_m"] = geo.length(c, C.R_ROUND)
    if spec.area:
        ring = geo.area(c) if spec.area == "plane" else geo.area_spherical(c)
        out["area_sqm"] = F.when(is_closed(refs), ring) if spec.area_if_closed else ring
    return out


def extract(m: GeoMap, spec: Spec | str, coord_scope: str = "all", lines: DataFrame | None = None) -> DataFrame:
    """elem, id, kind, category, name, the specification's columns, lon, lat and measures (null for nodes).

    Ways qualify with ``min_coords`` resolved vertices or more. ``lines`` may hand in resolved coordinates that several extractions share.
    """
    spec = SPECS[spec] if isinstance(spec, str) else spec
    tags = F.col("tags")
    own = {"kind": T.column(spec.kind, tags), "category": T.column(spec.category, tags), "name": tags["name"]} | {k: T.column(v, tags) for k, v in spec.columns.items()}
    measures = [c for c, on in (("length_m", spec.length), ("area_sqm", spec.area)) if on]
    parts = []
    if spec.node_where is not None:
        where = T.column(spec.where, tags)
        where = where if spec.node_where == ANY else where & T.column(spec.node_where, tags)
        parts.append(m.nodes.where(where).select(F.lit("node").alias("elem"), "id", *(c.alias(k) for k, c in own.items()), "lon", "lat", *(F.lit(None).cast("double").alias(c) for c in measures)))
    if spec.way_where is not None:
        where = T.column(spec.where, tags)
        where = where if spec.way_where == ANY else where & T.column(spec.way_where, tags)
        ways = m.ways.where(where)
        rows = ways.join((m.lines(coord_scope) if lines is None else lines).withColumnRenamed("way_id", "id"), "id").where(F.size("coords") >= spec.min_coords)
        lon, lat = geo.mean_point(F.col("coords"))
        parts.append(rows.select(F.lit("way").alias("elem"), "id", *(c.alias(k) for k, c in own.items()), lon.alias("lon"), lat.alias("lat"), *(c.alias(k) for k, c in _measured(spec, F.col("coords"), F.col("node_refs")).items())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance(tags: Column, key: Column, value: Column) -> Column:
    """3 to 10 of a named feature, one more with a wikipedia or wikidata tag."""
    base = F.lit(3)
    for (k, v), n in C.IMPORTANCE.items():
        base = F.when((key == k) & (value == v), n).otherwise(base)
    known = F.map_contains_key(tags, F.lit("wikipedia")) | F.map_contains_key(tags, F.lit("wikidata"))
    return F.least(F.lit(10), base + F.when(known, 1).otherwise(0))


def names(m: GeoMap, min_importance: int = 0) -> DataFrame:
    """Named nodes and ways with importance and alternative names (joined by a bar)."""
    tags = F.col("tags")
    spec = SPECS["names"]
    key, value = T.column(spec.category, tags), T.column(spec.kind, tags)
    alt = F.array_join(F.map_values(F.map_filter(tags, lambda k, _: k.startswith("name:") | k.isin("alt_name", "old_name", "official_name", "short_name"))), "|")
    both = m.nodes.select(F.lit("node").alias("elem"), "id", "tags").unionByName(m.ways.select(F.lit("way").alias("elem"), "id", "tags"))
    out = both.where(T.column(spec.where, tags)).select("elem", "id", tags["name"].alias("name"), key.alias("feature"), value.alias("kind"), importance(tags, key, value).alias("importance"), alt.alias("alt_names"))
    return out.where(F.col("importance") >= min_importance)


def buildings(m: GeoMap, floor_height: float = 3.0, estimate: bool = True, min_height: float | None = None) -> DataFrame:
    """Building outlines with height (tag, else levels times floor height), levels, roof and area."""
    t = F.col("tags")
    levels = units.number(t["building:levels"]).cast("int")
    tagged = F.coalesce(units.height(t["height"]), units.height(t["building:height"]))
    high = F.coalesce(tagged, levels * floor_height) if estimate else tagged
    source = F.when(tagged.isNotNull(), "tag").when(high.isNotNull(), "levels")
    rows = m.way_geometry().where(F.map_contains_key("tags", F.lit("building")) & (F.size("coords") >= 3))
    rows = rows.select("id", t["building"].alias("kind"), t["name"].alias("name"), levels.alias("levels"), high.alias("height_m"), source.alias("height_source"), t["roof:shape"].alias("roof_shape"), geo.area(F.col("coords")).alias("area_sqm"))
    return rows if min_height is None else rows.where(F.col("height_m") >= min_height)


def estimated_height(tags: Column) -> Column:
    """Height of a building for drawing: tag, levels times 3, by type, or 10."""
    types = F.create_map(*(x for k, v in C.BUILDING_HEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(units.number(F.regexp_replace(tags["height"], "m", "")), units.number(tags["building:levels"]).cast("int") * 3.0, F.element_at(types, tags["building"]), F.lit(10.0))


def road_class(highway: Column) -> Column:
    out = F.lit("other")
    for k, v in reversed(C.ROAD_CLASSES.items()):
        out = F.when(highway.isin(*v), k).otherwise(out)
    return out


def roads(m: GeoMap) -> DataFrame:
    """Every way with a highway tag and two points: class, lanes, width, maxspeed, oneway, lit, length."""
    t, c = F.col("tags"), F.col("coords")
    rows = m.way_geometry().where(F.map_contains_key("tags", F.lit("highway")) & (F.size("coords") >= 2))
    return rows.select(
        "id", t["highway"].alias("highway"), road_class(t["highway"]).alias("road_class"), t["name"].alias("name"), t["surface"].alias("surface"), units.number(t["lanes"]).cast("int").alias("lanes"),
        units.height(t["width"]).alias("width_m"), units.speed_int(t["maxspeed"]).alias("maxspeed"), units.truthy(t["oneway"], "yes", "1", "true").alias("oneway"), units.truthy(t["lit"], "yes").alias("lit"), geo.length(c, C.R_ROUND).alias("length_m"),
    )


def road_geometry(m: GeoMap, highways: tuple[str, ...] | None = None, infrastructure: bool = False, only_infrastructure: bool = False) -> DataFrame:
    """Roads with length, sinuosity, bearing, speed, travel time and lane kilometres; with infrastructure also bridge, tunnel, ford, layer and infra_type."""
    t, c = F.col("tags"), F.col("coords")
    rows = m.way_geometry().where(F.size("coords") >= 2)
    rows = rows.where(t["highway"].isin(*highways) if highways else F.map_contains_key("tags", F.lit("highway")))
    speeds = F.create_map(*(x for k, v in C.EXTRACT_SPEEDS.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = rows.withColumn("_m", geo.length(c, C.R_MEAN))
    metres = F.col("_m")
    speed = F.coalesce(units.speed_leading(t["maxspeed"]), F.element_at(speeds, t["highway"]), F.lit(40.0))
    lanes = F.coalesce(units.number(t["lanes"]).cast("int"), F.lit(2))
    sides = F.coalesce(t["sidewalk:left"], F.lit("no")) != "no"
    sides = sides | (F.coalesce(t["sidewalk:right"], F.lit("no")) != "no")
    cols = [
        "id", t["highway"].alias("highway"), t["name"].alias("name"), F.round(metres, 1).alias("length_m"), F.round(metres / 1000, 3).alias("length_km"), F.round(geo.sinuosity(c), 3).alias("sinuosity"),
        F.round(geo.line_bearing(c), 1).alias("bearing"), F.round(speed, 0).alias("speed_kph"), F.round(metres / 1000 / speed * 60, 2).alias("travel_min"), lanes.alias("lanes"), F.round(lanes * metres / 1000, 3).alias("lane_km"),
        (units.has_sidewalk(t["sidewalk"]) | sides).alias("has_sidewalk"), units.is_lit(t["lit"]).alias("is_lit"), units.is_oneway(t["oneway"]).alias("is_oneway"),
    ]
    if infrastructure or only_infrastructure:
        kind = infra_type(t)
        rows = rows.where(kind.isNotNull()) if only_infrastructure else rows
        cols += [t["bridge"].alias("bridge"), t["tunnel"].alias("tunnel"), t["ford"].alias("ford"), F.coalesce(t["layer"], F.lit("0")).alias("layer"), kind.alias("infra_type")]
    return rows.select(*cols)


def traffic_safety(m: GeoMap) -> DataFrame:
    """(elem, id, feature) for every traffic-safety tag, by a join of the tags with the small feature table."""
    table = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(k).alias("key"), F.lit(v).alias("value")) for n, k, v in C.SAFETY))
    small = F.broadcast(m.nodes.sparkSession.range(1).select(F.inline(table)))  # len(SAFETY) rows
    both = m.nodes.select(F.lit("node").alias("elem"), "id", "tags").unionByName(m.ways.select(F.lit("way").alias("elem"), "id", "tags"))
    return both.select("elem", "id", F.explode("tags").alias("key", "value")).join(small, ["key", "value"]).select("elem", "id", "feature")


def cycling(m: GeoMap) -> DataFrame:
    """(elem, id, feature) of the cycling definitions; an element may have several."""
    t = F.col("tags")

    def hits(elem: str) -> Column:
        parts = [F.when(T.column(T.all_of(T.isin(k, v), *([T.isin(k2, v2)] if k2 else [])), t), F.lit(n)) for n, e, k, v, k2, v2 in C.CYCLING if e == elem]
        return F.explode(F.array_compact(F.array(*parts)))

    return m.nodes.select(F.lit("node").alias("elem"), "id", hits("node").alias("feature")).unionByName(m.ways.select(F.lit("way").alias("elem"), "id", hits("way").alias("feature")))


def description(tags: Column) -> Column:
    """A feature in words, by its first describing key."""
    out = F.lit("feature")
    for key, before, after in reversed(C.DESCRIPTIONS):
        text = tags[key] if key == "building" else F.replace(tags[key], F.lit("_"), F.lit(" "))
        text = F.concat(F.lit(before), text, F.lit(after))
        if key == "building":
            text = F.when(tags[key] == "yes", "building").otherwise(text)
        out = F.when(F.map_contains_key(tags, F.lit(key)), text).otherwise(out)
    return out
