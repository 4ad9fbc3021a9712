"""An overlay of a road graph: cells of bounded size, and shortcuts between their borders.

Relaxation on the roads themselves takes as many rounds as a path has edges. The
overlay cuts the nodes, in the order of a curve through the plane, into cells of
as many nodes each; edges between cells stay, and inside a cell every border
node gets an edge to every other that it reaches there, found by Dijkstra's
algorithm in the cell's task. Then a search takes as many rounds as a path has
cells and crossings, and costs are the same. It is built once, stored, and used
by many searches; a search adds shortcuts for its own stops in their cells only.
Where most nodes are border nodes (a graph without places) it does not pay.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, scratch, ship
from . import forest, routing

#: Nodes in a cell.
CELL = 2000
_BITS = 16
_TABLES = ("cells", "inner", "cross", "borders", "shortcuts")


@dataclass(frozen=True)
class Overlay:
    """cells(id, cell); inner and cross: edges inside cells (with cell) and between them; borders(id, cell); shortcuts(src, dst, cost, distance_m)."""

    cells: DataFrame
    inner: DataFrame
    cross: DataFrame
    borders: DataFrame
    shortcuts: DataFrame


def along_curve(lat: Column, lon: Column) -> Column:
    """The place of a point on a curve of nested quadrants: the bits of both coordinates in turn."""
    scaled = lambda c, low, width: F.least(F.lit((1 << _BITS) - 1), F.floor((c - low) / width * (1 << _BITS))).cast("long")
    y, x = scaled(lat, -90.0, 180.0), scaled(lon, -180.0, 360.0)
    out = F.lit(0).cast("long")
    for i in range(_BITS):
        bit = lambda c: F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long"))  # noqa: B023, E731
        out = out.bitwiseOR(F.shiftleft(bit(y), 2 * i + 1)).bitwiseOR(F.shiftleft(bit(x), 2 * i))
    return out


def _graph(rows: pd.DataFrame, turned: bool = False) -> routing.Graph:
    return routing.graph_of(rows.rename(columns={"src": "dst", "dst": "src"}) if turned else rows)


def _reached(g: routing.Graph, i: int) -> dict[int, tuple[float, float]]:
    """node -> (cost, metres of the cheapest path) from node i."""
    best, via = g.tree(i)
    metres = {i: 0.0}
    for u in sorted(best, key=best.__getitem__):
        if u != i:
            metres[u] = metres[g.origin(via[u])] + float(g.metres[via[u]])
    return {u: (best[u], metres[u]) for u in best}


def _links(edges: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Shortcuts of one cell: between all borders, or, where some points are stops, between stops and all points."""
    out, ids = [], points["id"].to_numpy()
    stops = points.loc[points["stop"], "id"].to_numpy()
    if len(edges):
        g = _graph(edges)
        for s in stops if len(stops) else ids:
            found = _reached(g, i) if (i := g.index(s)) >= 0 else {}
            out += [(s, t, *found[j]) for t in ids if (j := g.index(t)) in found and t != s]
        g = _graph(edges, turned=True)
        for t in stops:
            found = _reached(g, i) if (i := g.index(t)) >= 0 else {}
            out += [(s, t, *found[j]) for s in ids if (j := g.index(s)) in found and s != t and s not in stops]
    return pd.DataFrame({c: [r[k] for r in out] for k, c in enumerate(("src", "dst", "cost", "distance_m"))})


def _shortcuts(inner: DataFrame, points: DataFrame) -> DataFrame:
    kind = dict(inner.dtypes)["src"]
    ship(inner.sparkSession)
    cell = inner.select("cell", "src", "dst", "cost", "distance_m", "way_id", "pos").groupBy("cell")
    return cell.cogroup(points.select("cell", "id", "stop").groupBy("cell")).applyInPandas(_links, f"src {kind}, dst {kind}, cost double, distance_m double")


def build(edges: DataFrame, coords: DataFrame, weight: str = "time_s", cell_nodes: int = CELL, path: str | None = None) -> Overlay:
    """The overlay of an edge table, stored below ``path`` (or a new folder); ``load`` reads it again."""
    spark = edges.sparkSession
    path = path or scratch(spark, "overlay")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(coords, "id").select("id", along_curve(F.col("lat"), F.col("lon")).alias("z"))
    placed = forest.in_order(nodes, "z", "id", name="no").select("id", F.floor(F.col("no") / cell_nodes).alias("cell"))
    placed.write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    ends = [cells.select(F.col("id").alias(c), F.col("cell").alias(f"cell_{c}")) for c in ("src", "dst")]
    rows = edges.where("src <> dst").join(ends[0], "src").join(ends[1], "dst").withColumn("cost", F.col(weight))
    cols = list(dict.fromkeys([*edges.columns, "cost"]))
    rows.where("cell_src = cell_dst").select(*cols, F.col("cell_src").alias("cell")).write.parquet(f"{path}/inner")
    rows.where("cell_src <> cell_dst").select(*cols, "cell_src", "cell_dst").write.parquet(f"{path}/cross")
    inner, cross = (spark.read.parquet(f"{path}/{t}") for t in ("inner", "cross"))
    both = cross.select(F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.col(f"cell_{c}").alias("cell")) for c in ("src", "dst")))).alias("x"))
    both.select("x.id", "x.cell").distinct().write.parquet(f"{path}/borders")
    _shortcuts(inner, spark.read.parquet(f"{path}/borders").withColumn("stop", F.lit(False))).write.parquet(f"{path}/shortcuts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Overlay:
    return Overlay(*(spark.read.parquet(f"{path}/{t}") for t in _TABLES))


def _search_edges(o: Overlay, stops: list) -> DataFrame:
    """The overlay's edges with those of some stops."""
    spark, kind = o.cells.sparkSession, dict(o.cells.dtypes)["id"]
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(stops)], f"id {kind}")  # the caller's stops
    at = cut(o.cells.join(F.broadcast(asked), "id").select("id", "cell"))
    where = F.broadcast(at.select("cell").distinct())
    borders = o.borders.join(where, "cell", "left_semi").join(F.broadcast(at), ["id", "cell"], "left_anti")
    points = borders.select("id", "cell", F.lit(False).alias("stop")).unionByName(at.withColumn("stop", F.lit(True)))
    own = _shortcuts(o.inner.join(where, "cell", "left_semi"), points)
    zero = F.lit(0.0)
    own = own.unionByName(at.select(F.col("id").alias("src"), F.col("id").alias("dst"), zero.alias("cost"), zero.alias("distance_m")))  # a stop without a way out is in the graph
    none = lambda d: d.select("src", "dst", "cost", "distance_m", F.lit(None).cast(dict(o.cross.dtypes)["way_id"]).alias("way_id"), F.lit(None).cast(dict(o.cross.dtypes)["pos"]).alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in (("highway", "string"), ("name", "string"), ("time_s", "double"))))
    cross = o.cross.select("src", "dst", "cost", "distance_m", "way_id", "pos", "highway", "name", "time_s")
    return cut(cross.unionByName(none(o.shortcuts)).unionByName(none(own)))


def costs(o: Overlay, sources: list, targets: list) -> DataFrame:
    """(source, node, cost, distance_m) of the targets that each source reaches; of equally cheap paths the shortest."""
    edges = _search_edges(o, [*sources, *targets])
    kind = dict(o.cells.dtypes)["id"]
    wanted = o.cells.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(targets)], f"node {kind}")
    return routing.relax(edges, sources, "cost", metres=True).join(F.broadcast(wanted), "node").select("source", "node", "cost", "distance_m")


def distance_matrix(o: Overlay, nodes: list) -> DataFrame:
    """As routing.distance_matrix, through the overlay."""
    spark, kind = o.cells.sparkSession, dict(o.cells.dtypes)["id"]
    found = costs(o, nodes, nodes).select(F.col("source").alias("origin"), F.col("node").alias("destination"), "cost", "distance_m")
    points = spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], f"n {kind}")  # the caller's list
    return points.withColumnRenamed("n", "origin").crossJoin(points.withColumnRenamed("n", "destination")).join(found, ["origin", "destination"], "left")


def _unpacked(o: Overlay, steps: DataFrame) -> DataFrame:
    """The edges of the shortcuts among some steps: (leg, seq, sub, src, dst, way_id, pos), each cell's in its own task."""
    kind = dict(o.inner.dtypes)
    short = steps.where("way_id is null").join(o.cells.withColumnRenamed("id", "src"), "src").select("cell", "leg", "seq", "src", "dst")
    where = F.broadcast(short.select("cell").distinct())

    def walk(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        g, out = _graph(edges), []
        for r in asked.itertuples(index=False):
            _, via = g.tree(g.index(r.src), {g.index(r.dst)})
            for sub, k in enumerate(g.path(via, g.index(r.dst))):
                out.append((r.leg, r.seq, sub, g.ids[g.origin(k)], g.ids[g.to[k]], g.way[k], g.pos[k]))
        return pd.DataFrame({c: [x[i] for x in out] for i, c in enumerate(("leg", "seq", "sub", "src", "dst", "way_id", "pos"))})

    cell = o.inner.join(where, "cell", "left_semi").select("cell", "src", "dst", "cost", "distance_m", "way_id", "pos").groupBy("cell")
    schema = f"leg int, seq int, sub int, src {kind['src']}, dst {kind['dst']}, way_id {kind['way_id']}, pos {kind['pos']}"
    return cell.cogroup(short.groupBy("cell")).applyInPandas(walk, schema)


def route_nodes(o: Overlay, stops: list) -> DataFrame:
    """As routing.route_nodes, through the overlay: the cheapest path over given nodes in order; empty if a leg has none."""
    spark, kind = o.cells.sparkSession, dict(o.cells.dtypes)["id"]
    pairs = list(zip(stops, stops[1:], strict=False))
    legs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"leg int, source {kind}, target {kind}")
    steps = cut(routing.joined_steps(_search_edges(o, stops), legs, "cost"))
    parts = _unpacked(o, steps)
    keys = ["src", "dst", "way_id", "pos"]
    named = o.inner.join(F.broadcast(cut(parts)), keys).select("leg", "seq", "sub", "src", "dst", "way_id", "highway", "name", "distance_m", "time_s")  # a few paths
    whole = named.unionByName(steps.where("way_id is not null").withColumn("sub", F.lit(0)).select(named.columns))
    no = F.row_number().over(Window.partitionBy("leg").orderBy("seq", "sub")) - 1  # one path
    whole = cut(whole.withColumn("seq", no).drop("sub"))
    there = whole.select("leg").distinct().count()
    return whole if there == sum(a != b for a, b in pairs) else whole.limit(0)
