"""Road graphs as edge tables: building, export, degrees and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import geo, units
from ..plans.model import GeoMap
from ..session import cut, stored
from .spatial import segments


#: References that a task sorts.
PART = 500_000


def _speed_map(speeds: dict) -> Column:
    return F.create_map(*(x for k, v in speeds.items() for x in (F.lit(k), F.lit(float(v)))))


def direction(oneway: Column, fix_reverse: bool = True) -> Column:
    """1 forwards only, -1 backwards only, 0 both."""
    v = F.lower(F.coalesce(oneway, F.lit("no")))
    back = F.lit(-1 if fix_reverse else 0)
    return F.when(v.isin("yes", "1", "true"), 1).when(v.isin("-1", "reverse"), back).otherwise(0)


def edges(m: GeoMap, mode: str = "drive", directed: bool = True, speed: str = "default", fix_reverse: bool = True, radius: float = C.R_ROUND) -> DataFrame:
    """(src, dst, way_id, pos, highway, name, distance_m, time_s) of a mode's roads.

    Only driving honours one-way roads; walking and cycling go both ways, as
    does everything with directed=False. speed "default" is the mode's table,
    "maxspeed" the tag where it is, else the network table.
    """
    t = F.col("tags")
    roads = m.ways.where(t["highway"].isin(*C.MODE_ROADS[mode]))
    seg = segments(m, strict=True, ways=roads).withColumn("distance_m", geo.haversine((F.col("lon1"), F.col("lat1")), (F.col("lon2"), F.col("lat2")), radius))
    if speed == "maxspeed" or mode == "all":
        kmh = F.coalesce(units.speed_int(t["maxspeed"]).cast("double"), F.element_at(_speed_map(C.NETWORK_SPEEDS), t["highway"]), F.lit(30.0))
    else:
        kmh = F.coalesce(F.element_at(_speed_map(C.MODE_SPEEDS[mode]), t["highway"]), F.lit(float(C.MODE_SPEEDS[mode]["default"])))
    attrs = roads.select(F.col("id").alias("way_id"), t["highway"].alias("highway"), t["name"].alias("name"), kmh.alias("kmh"), direction(t["oneway"], fix_reverse).alias("dir"))
    rows = seg.join(attrs, "way_id")
    both = F.lit(not directed or mode in ("walk", "walk_map", "bike"))
    ways = F.array_compact(F.array(F.when(both | (F.col("dir") >= 0), F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))), F.when(both | (F.col("dir") <= 0), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    rows = rows.withColumn("e", F.explode(ways))
    return rows.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "way_id", "pos", "highway", "name", "distance_m", (F.col("distance_m") / (F.col("kmh") * 1000 / 3600)).alias("time_s"))


def network(m: GeoMap, mode: str = "drive", directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for export: one edge a segment, or directed ones; length to 0.1 m, speed by tag or network table."""
    t = F.col("tags")
    roads = m.ways.where(t["highway"].isin(*C.MODE_ROADS[mode]))
    seg = segments(m, strict=True, ways=roads)
    kmh = F.coalesce(units.speed_int(t["maxspeed"]), F.element_at(_speed_map(C.NETWORK_SPEEDS), t["highway"]).cast("int"), F.lit(30))
    attrs = roads.select(F.col("id").alias("way_id"), t["highway"].alias("highway"), t["name"].alias("name"), kmh.alias("speed_kmh"), direction(t["oneway"]).alias("dir"))
    rows = seg.join(attrs, "way_id").withColumn("length_m", F.round(geo.haversine((F.col("lon1"), F.col("lat1")), (F.col("lon2"), F.col("lat2"))), 1))
    if directed:
        ends = F.array_compact(F.array(F.when(F.col("dir") >= 0, F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))), F.when(F.col("dir") <= 0, F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
        rows = rows.withColumn("e", F.explode(ends)).withColumn("src", F.col("e.a")).withColumn("dst", F.col("e.b"))
    out = rows.select("src", "dst", "way_id", "pos", "highway", "name", "length_m", "speed_kmh", (F.col("dir") != 0).alias("oneway"))
    nodes = out.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(m.coords, "id")
    return nodes, out


def links(m: GeoMap, mode: str = "drive") -> DataFrame:
    """(src, dst) of the segments of a mode's roads, for what needs neither places nor attributes: roads and nodes are only looked up, rows of three numbers are sorted, some PART references a task."""
    tasks = max(1, -(-m.way_refs().count() // PART))
    roads = m.ways.where(F.col("tags")["highway"].isin(*C.MODE_ROADS[mode])).select(F.col("id").alias("way_id"))
    refs = m.way_refs().repartition(tasks, "way_id").join(roads, "way_id", "left_semi").join(m.coords.select(F.col("id").alias("ref")), "ref", "left_semi")
    w = Window.partitionBy("way_id").orderBy("pos")
    rows = refs.select(F.col("ref").alias("src"), "pos", F.lead("ref").over(w).alias("dst"), F.lead("pos").over(w).alias("_next"))
    return rows.where("_next = pos + 1").select("src", "dst")


def degrees(e: DataFrame) -> DataFrame:
    """(id, degree): edge ends at every node."""
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def network_stats(e: DataFrame) -> DataFrame:
    """One row: nodes, edges, dead ends (degree 1), intersections (3 or more), total length in km."""
    d = degrees(e).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") == 1).alias("dead_ends"), F.count_if(F.col("degree") >= 3).alias("intersections"))
    return d.crossJoin(e.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m") / 1000, 3).alias("length_km")))


def components(e: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named by their smallest node.

    Every round points each node at its smallest neighbour, follows the pointers
    to their ends by doubling and contracts the graph to these ends, so the
    number of rounds is logarithmic; each round's tables are checkpointed.
    """
    live = cut(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    labels = cut(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")))
    live = live.where("a <> b")
    while live.take(1):
        point = live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("x")).groupBy("x.v").agg(F.min("x.n").alias("n")).select("v", F.least("v", "n").alias("to"))
        point, moved = cut(point), True
        while moved:
            hop = point.select(F.col("v").alias("to"), F.col("to").alias("hop"))
            point = stored(point.join(hop, "to", "left").select("v", F.coalesce("hop", "to").alias("to"), (F.coalesce("hop", "to") != F.col("to")).alias("moved")))
            moved = bool(point.where("moved").take(1))
            point = point.select("v", "to")
        labels = cut(labels.join(point.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = [point.select(F.col("v").alias(c), F.col("to").alias(f"{c}2")) for c in "ab"]
        live = live.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2")
        live = cut(live.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels


def connectivity(e: DataFrame) -> DataFrame:
    """(component, size, pct): sizes of the weak components, largest first."""
    sizes = components(e).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.crossJoin(sizes.agg(F.sum("size").alias("n"))).select("component", "size", F.round(100.0 * F.col("size") / F.col("n"), 2).alias("pct")).orderBy(F.desc("size"), "component")


# --- along directed edges

def _least_reaching(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(id, col): the smallest ``col`` (no, id) of all nodes that reach a node, itself included.

    A round takes the smallest of the nodes before, then that of the node which
    ``col`` names: what reaches it reaches this one, too. So labels travel by
    leaps, in far fewer rounds than a path has edges.
    """
    labels = stored(nodes)
    while True:
        come = e.join(labels.select(F.col("id").alias("src"), F.col("col").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(come, "id", "left").select("id", F.col("col").alias("old"), F.least("col", "c").alias("col")).withColumn("to", F.col("col.id"))
        leap = labels.select(F.col("id").alias("to"), F.col("col").alias("c"))
        labels = stored(step.join(leap, "to").select("id", F.least("col", "c").alias("col"), (F.least("col", "c") != F.col("old")).alias("moved")))
        if not labels.where("moved").take(1):
            return labels.select("id", "col")


def _ends(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def reach_components(e: DataFrame) -> DataFrame:
    """(id, component): nodes by the smallest node that reaches them along directed edges.

    That is what a search from every node in turn, smallest first, leaves to
    each start: whoever is reached by a smaller one was taken before.
    """
    e = cut(e.select("src", "dst").where("src <> dst").distinct().unionByName(e.select("src", "dst").where("src = dst").distinct()))
    return _least_reaching(_ends(e).select("id", F.struct(F.lit(0).alias("no"), "id").alias("col")), e).select("id", F.col("col.id").alias("component"))


def strong_components(e: DataFrame) -> DataFrame:
    """(id, component): nodes that reach each other along directed edges, named by the smallest.

    A round gives every node the first node, in an order drawn anew, that
    reaches it; edges between different ones go, since no cycle has them. Nodes
    that reach their first one back are its component and leave. Nodes without
    a way in or out leave before, alone.
    """
    nodes = cut(_ends(e))
    live, done, no = cut(e.select("src", "dst").where("src <> dst").distinct()), [], 0
    while live.take(1):
        inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner, no = stored(inner.select("src", "dst")), no + 1
        if not inner.take(1):
            break
        drawn = stored(_ends(inner).select("id", F.struct(F.xxhash64(F.lit(no), F.col("id")).alias("no"), "id").alias("col")))
        first = _least_reaching(drawn, inner)
        colour = [first.select(F.col("id").alias(c), F.col("col").alias(f"col_{c}")) for c in ("src", "dst")]
        same = stored(inner.join(colour[0], "src").join(colour[1], "dst").where("col_src = col_dst").select("src", "dst"))
        back = _least_reaching(drawn, same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = stored(first.join(back.withColumnRenamed("col", "back"), "id").where("col = back").select("id", F.col("col.id").alias("root")))
        done.append(found)
        left = found.select("id")
        live = stored(same.join(left.withColumnRenamed("id", "src"), "src", "left_anti").join(left.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    roots = nodes.withColumn("root", F.col("id"))
    if done:
        found = done[0]
        for d in done[1:]:
            found = found.unionByName(d)
        roots = nodes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    roots = stored(roots)
    names = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(names, "root").select("id", "component")


def directed_stats(e: DataFrame) -> DataFrame:
    """One row: nodes, components and largest of reach_components, dead ends (one neighbour ahead) and intersections (three or more)."""
    sizes = reach_components(e).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    ahead = e.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return sizes.crossJoin(ahead.agg(F.count_if(F.col("n") == 1).alias("dead_ends"), F.count_if(F.col("n") >= 3).alias("intersections")))  # one row each
