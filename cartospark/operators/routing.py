"""Shortest paths and what is built on them.

Two ways to the same paths. A graph of up to MAX_EDGES edges (counted first) is
packed into arrays of numbers, sent to the workers once, and each source or leg
runs Dijkstra's algorithm in one of them; names are joined to the paths found.
In a larger graph a pair of nodes is searched from both ends (``met``): tasks ask
for the edges of the cheapest nodes met so far, until the two balls of half the
cheapest cost are there. For whole trees only what the sources reach is looked at: a set of nodes grows
hop by hop, and parts of it that no edge joins are packed each in a task of its
own. Parts that are too large stay a table: ``relax`` lowers costs by joins with
the edge table until nothing changes, from all sources at once, and
``joined_steps`` follows its trees back to the source by pointer doubling, so a
path of n steps takes about log2(n) joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import geo, units
from ..plans import tagexpr as T
from ..plans.features import SPECS
from ..plans.model import GeoMap
from ..session import cut, scratch, ship, stored
from . import geometry, network, spatial

#: Edges of a packed graph: 48 bytes each where ids are numbers.
MAX_EDGES = 1_000_000
#: Hops after which nodes that are still met for the first time are left to relaxation.
HOPS = 32
#: Rows of a counted table up to which a join sends it to all tasks.
SMALL = 500_000
#: Sources that one task searches from in its part of a graph.
SOURCES = 16
#: Edges around the ends of a pair that one task holds; pairs that need more are left to other ways.
BALL = 1_000_000
#: Nodes whose edges an end of a pair asks for at once, at least.
ASKED = 2_000
#: Cells that a walk to a POI is long.
CELLS = 6
#: Pairs up to which both ends of each are searched from.
PAIRS = 1_000


@dataclass
class Graph:
    """Adjacency arrays: node ids (sorted), and of each node's edges the target, cost, length, way and place in it."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray
    cost: np.ndarray
    metres: np.ndarray
    way: np.ndarray
    pos: np.ndarray

    def index(self, node) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def tree(self, source: int, targets: set[int] | None = None, bound: float = float("inf"), cost: np.ndarray | None = None):
        """(cost, edge that leads to it) of every node reached from a source, until all targets are settled or costs exceed the bound. Equal costs: the smaller node first."""
        cost = self.cost if cost is None else cost
        best, via, settled = {source: 0.0}, {source: -1}, set()
        heap, wanted = [(0.0, source)], set(targets) if targets else None
        while heap:
            d, u = heapq.heappop(heap)
            if u in settled:
                continue
            if d > bound:
                break
            settled.add(u)
            if wanted is not None:
                wanted.discard(u)
                if not wanted:
                    break
            for k in range(self.start[u], self.start[u + 1]):
                v, c = int(self.to[k]), d + float(cost[k])
                if c < best.get(v, float("inf")):
                    best[v], via[v] = c, k
                    heapq.heappush(heap, (c, v))
        return {u: best[u] for u in settled}, via

    def origin(self, edge: int) -> int:
        return int(np.searchsorted(self.start, edge, side="right") - 1)

    def path(self, via: dict[int, int], target: int) -> list[int]:
        """Edges from the tree's source to a target."""
        out = []
        while (k := via[target]) >= 0:
            out.append(k)
            target = self.origin(k)
        return out[::-1]


def pack(edges: DataFrame, weight: str = "time_s") -> Graph:
    """The graph of an edge table; ValueError beyond MAX_EDGES."""
    n = edges.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges are more than {MAX_EDGES}: use relax()")
    return graph_of(edges.select("src", "dst", F.col(weight).alias("cost"), "distance_m", "way_id", "pos").toPandas())


def graph_of(rows: pd.DataFrame) -> Graph:
    """The graph of rows (src, dst, cost, distance_m, way_id, pos)."""
    rows, n = rows.sort_values(["src", "dst", "cost", "way_id", "pos"], kind="stable"), len(rows)
    ids = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()])) if n else np.array([])
    src = np.searchsorted(ids, rows["src"].to_numpy()) if n else np.array([], dtype=int)
    to = np.searchsorted(ids, rows["dst"].to_numpy()) if n else src
    return Graph(ids, np.searchsorted(src, np.arange(len(ids) + 1)), to, rows["cost"].to_numpy(dtype=float), rows["distance_m"].to_numpy(dtype=float), rows["way_id"].to_numpy(), rows["pos"].to_numpy())


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def reached(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, int] | None:
    """((id, part), number): all nodes that ``sources`` (id) reach, in parts that no edge joins; None if that takes more than HOPS hops.

    A round reads the edges once and keeps the nodes met for the first time.
    They carry the smallest source they were met from; sources whose nodes an
    edge joins are one part.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "reached")
    ends, total = edges.select("src", "dst"), 0
    fresh = sources.select("id", F.col("id").alias("part")).distinct()
    read = spark.read.schema(fresh.schema).option("recursiveFileLookup", "true")
    fresh.write.parquet(f"{path}/0")
    for no in range(HOPS + 1):
        fresh = read.parquet(f"{path}/{no}")
        n = fresh.count()
        if not n:
            break
        seen, total = read.parquet(path), total + n
        step = ends.join(_sent(fresh.withColumnRenamed("id", "src"), n), "src").groupBy(F.col("dst").alias("id")).agg(F.min("part").alias("part"))
        step.join(_sent(seen.select("id"), total), "id", "left_anti").write.parquet(f"{path}/{no + 1}")
    else:
        return None
    nodes = read.parquet(path)
    at = [_sent(nodes.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}")), total) for c in ("src", "dst")]
    joined = ends.join(at[0], "src").join(at[1], "dst").where("part_src <> part_dst").select(F.col("part_src").alias("src"), F.col("part_dst").alias("dst")).distinct()
    named = network.components(joined).withColumnRenamed("id", "part")
    return stored(nodes.join(named, "part", "left").select("id", F.coalesce("component", "part").alias("part"))), total


def narrowed(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(edges with their part, nodes (id, part)) of what ``sources`` (id) reach; None where ``reached`` gives up. A source that no edge leaves gets a loop."""
    found = reached(edges, sources)
    if found is None:
        return None
    nodes, n = found
    near = edges.join(_sent(nodes.withColumnRenamed("id", "src"), n), "src").select(*edges.columns, "part")
    asked = nodes.join(F.broadcast(sources.select("id").distinct()), "id", "left_semi") if n > SMALL else nodes.join(sources, "id", "left_semi")
    stay = cut(asked.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    if stay.take(1):
        stay = stay.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        kind = dict(edges.dtypes)
        known = {"src": F.col("id"), "dst": F.col("id"), "part": F.col("part"), "way_id": F.lit(0).cast(kind.get("way_id", "long")), "pos": F.lit(0).cast(kind.get("pos", "int"))}
        near = near.unionByName(stay.select(*(known.get(c, F.lit(0.0) if kind.get(c) == "double" else F.lit(None).cast(kind.get(c, "string"))).alias(c) for c in near.columns)))
    return stored(near), nodes


def in_parts(edges: DataFrame, asked: DataFrame, weight: str, search: Callable[[Graph, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, most: int | None = None, sources: int = SOURCES) -> tuple[DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """(what ``search`` finds for rows of ``asked``, a table with a column source; the edges and rows of what is too large for a task).

    A graph of up to MAX_EDGES edges, or as much of it as the sources reach, is
    sent to the workers; of a larger one every part of up to ``most`` edges
    (MAX_EDGES) goes to tasks of its own, one for every ``sources`` rows.
    """
    spark, most = edges.sparkSession, most or MAX_EDGES
    ship(spark)
    nodes = None
    if edges.count() > MAX_EDGES:
        found = narrowed(edges, asked.select(F.col("source").alias("id")))
        if found is None:
            return None, (edges, asked)
        edges, nodes = found
    if edges.count() <= MAX_EDGES:
        shared = spark.sparkContext.broadcast(pack(edges, weight))  # at most MAX_EDGES edges

        def whole(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                yield from search(shared.value, pdf)

        return asked.repartition(max(1, min(64, asked.count()))).mapInPandas(whole, schema), None
    large = cut(edges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part"))
    asked = cut(asked.join(nodes.withColumnRenamed("id", "source"), "source"))
    few = asked.join(F.broadcast(large), "part", "left_anti")  # at most as many as ``most`` fits into all edges
    rooms = few.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / sources).alias("rooms"))
    few = few.join(rooms, "part").withColumn("room", F.pmod(F.xxhash64("source"), F.col("rooms"))).drop("rooms")
    rows = edges.join(rooms.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)).alias("room")), "part").select("part", "room", "src", "dst", F.col(weight).alias("cost"), "distance_m", "way_id", "pos")
    names = [f.split()[0] for f in schema.split(", ")]

    def part(held: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(search(graph_of(held), pdf)) if len(held) and len(pdf) else []
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    done = rows.groupBy("part", "room").cogroup(few.groupBy("part", "room")).applyInPandas(part, schema)
    if not large.take(1):
        return done, None
    return done, (stored(edges.join(F.broadcast(large), "part", "left_semi").drop("part")), cut(asked.join(F.broadcast(large), "part", "left_semi").drop("part")))


def _half(cost: float) -> float:
    """How far from either end the nodes of a path of that cost are looked for; a little more, for rounding."""
    return cost / 2 * (1 + 1e-9) + 1e-9


def _nodes_asked(held: pd.DataFrame, start, side: int, asked: set) -> tuple[dict, list]:
    """({node: cost}, [(cost, node) whose edges were not asked for]) of one end of a pair, cheapest first."""
    if side:
        held = held.rename(columns={"src": "dst", "dst": "src"})
    g = graph_of(held)
    i = g.index(start)
    best = {g.ids[u]: c for u, c in g.tree(i)[0].items()} if i >= 0 else {start: 0.0}
    return best, sorted((c, u) for u, c in best.items() if u not in asked)


def met(edges: DataFrame, pairs: DataFrame, weight: str, find: Callable) -> tuple[DataFrame, DataFrame]:
    """((pair, leg, seq, src, dst, way_id, pos, cost, distance_m): the paths of pairs (pair, source, target), costs from the source on; the pairs left).

    ``find(graph, row, within)`` returns ([(leg, path)], the cost of the dearest
    path looked at). A path of cost c has its nodes within c / 2 of one of its
    ends. So each end asks for the edges of its cheapest nodes, batch by batch,
    until all within half of the cheapest cost known are there; then the paths
    found in these edges are those of the whole graph. If ``find`` needs dearer
    ones, the balls grow. A path of seq -1 is the source itself. Pairs that take
    more than HOPS rounds or BALL edges are left.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "met")
    ship(spark)
    kind, most, least = dict(edges.dtypes), BALL, ASKED
    lean = edges.select("src", "dst", F.col(weight).alias("cost"), "distance_m", "way_id", "pos")
    graph = f"pair int, side int, src {kind['src']}, dst {kind['dst']}, cost double, distance_m double, way_id {kind['way_id']}, pos {kind['pos']}"
    schema = graph + ", leg int, seq int"
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("src")), F.struct(F.lit(1).alias("side"), F.col("target").alias("src")))).alias("x")
    names = [f.split()[0] for f in schema.split(", ")]
    starts = pairs.select("pair", sides).select("pair", "x.side", "x.src")
    spark.createDataFrame([], schema).unionByName(starts, allowMissingColumns=True).write.parquet(f"{path}/rows/0")

    def grow(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """What an end asks for (side 0 and 1), steps of paths (2), or a pair to be left (3)."""
        pair = int(rows["pair"].iloc[0])
        none = pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        if len(held) > most:
            return none.reindex(range(1)).assign(pair=pair, side=3)
        asked = [set(rows.loc[rows["side"] == i, "src"]) for i in (0, 1)]
        ends = rows.loc[rows["first"], ["side", "src"]].set_index("side")["src"]
        row = pd.Series({"pair": pair, "source": ends[0], "target": ends[1]})
        known, fresh = zip(*(_nodes_asked(held[held["side"] == i], ends[i], i, asked[i]) for i in (0, 1)), strict=True)
        need = min((c + known[1][u] for u, c in known[0].items() if u in known[1]), default=float("inf"))
        if need == float("inf") and not all(fresh):
            return none  # an end is walled in: no path
        while True:
            out = []
            for i in (0, 1):
                batch = [u for c, u in fresh[i] if c <= _half(need)][: max(least, len(asked[i]))]
                out.append(pd.DataFrame({"pair": pair, "side": i, "src": batch}))
            out = pd.concat(out)
            if len(out):
                return out.reindex(columns=names)
            g = graph_of(held.drop_duplicates(["src", "dst", "way_id", "pos"]))
            legs, dearest = find(g, row, 2 * _half(need))
            if dearest <= 2 * _half(need):
                break
            need = dearest
        out = []
        for leg, steps in legs:
            at = [g.origin(k) for k in steps]
            i = g.index(row["source"])
            run = {"src": g.ids[[i, *at]], "dst": g.ids[[i, *g.to[steps]]], "way_id": [None, *g.way[steps]], "pos": [None, *g.pos[steps]]}
            out.append(pd.DataFrame(run | {"cost": np.cumsum([0.0, *g.cost[steps]]), "distance_m": np.cumsum([0.0, *g.metres[steps]]), "leg": leg, "seq": range(-1, len(steps))}, dtype=object))
        return pd.concat(out).assign(pair=pair, side=2)[names] if out else none

    read = lambda part, s: spark.read.schema(s).option("recursiveFileLookup", "true").parquet(f"{path}/{part}")
    first, tasks = starts.withColumn("first", F.lit(True)), max(1, min(64, pairs.count()))
    for no in range(HOPS):
        wanted = spark.read.schema(schema).parquet(f"{path}/rows/{no}").where("side < 2").select("pair", "side", F.col("src").alias("node"))
        n = wanted.count()
        if not n:
            break
        near = [lean.join(_sent(wanted.where(F.col("side") == i).withColumnRenamed("node", c), n), c) for i, c in enumerate(("src", "dst"))]
        near[0].unionByName(near[1]).select(*names[:8]).write.parquet(f"{path}/edges/{no}")
        open_ = F.broadcast(wanted.select("pair").distinct())
        rows = read("rows", schema).where("side < 2").join(open_, "pair").join(first, ["pair", "side", "src"], "left").select("pair", "side", "src", F.coalesce("first", F.lit(False)).alias("first"))
        held = read("edges", graph).join(open_, "pair")
        held, rows = held.repartition(tasks, "pair"), rows.repartition(tasks, "pair")
        held.groupBy("pair").cogroup(rows.groupBy("pair")).applyInPandas(grow, schema).write.parquet(f"{path}/rows/{no + 1}")
    else:
        no = HOPS
    done = read("rows", schema)
    left = done.where("side = 3").select("pair").unionByName(spark.read.schema(schema).parquet(f"{path}/rows/{no}").where("side < 2").select("pair")).distinct()
    return done.where("side = 2").select("pair", "leg", "seq", "src", "dst", "way_id", "pos", "cost", "distance_m"), cut(pairs.join(left, "pair"))


def pair_costs(edges: DataFrame, pairs: DataFrame, weight: str = "time_s") -> DataFrame:
    """(pair, source, target, cost, distance_m) of the pairs (pair, source, target) that a path joins, on a graph of any size; distance_m is that of the cheapest path."""
    whole = lambda p: p.join(costs(edges, [r["source"] for r in p.select("source").distinct().collect()], weight).withColumnRenamed("node", "target"), ["source", "target"]).select("pair", "source", "target", "cost", "distance_m")  # noqa: E731  the caller's list
    if pairs.count() > PAIRS or edges.count() <= MAX_EDGES:
        return whole(pairs)
    found, left = met(edges, pairs, weight, _cheapest)
    last = found.groupBy("pair").agg(F.max_by(F.struct("cost", "distance_m"), "seq").alias("l"))
    out = pairs.join(last, "pair").select("pair", "source", "target", "l.cost", "l.distance_m")
    return out.unionByName(whole(left)) if left.take(1) else out


def _cheapest(g: Graph, row, within: float = float("inf")) -> tuple[list[tuple[int, list[int]]], float]:
    """The cheapest path of a row (pair, source, target), for ``met``."""
    i, j = g.index(row["source"]), g.index(row["target"])
    if i < 0 or j < 0:
        return [], 0.0
    best, via = g.tree(i, {j})
    return ([(row["pair"], g.path(via, j))], best[j]) if j in best else ([], 0.0)


def costs(edges: DataFrame, sources: list, weight: str = "time_s", bound: float = float("inf")) -> DataFrame:
    """(source, node, cost, distance_m) of everything that each source reaches within the bound, on a graph of any size; distance_m is that of the cheapest path."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]

    def search(g: Graph, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for s in pdf["source"]:
            i = g.index(s)
            if i < 0:
                continue
            best, via = g.tree(i, bound=bound)
            metres = {i: 0.0}
            for u in sorted(best, key=best.__getitem__):
                if u != i:
                    metres[u] = metres[g.origin(via[u])] + float(g.metres[via[u]])
            keep = [u for u in best if best[u] <= bound]
            yield pd.DataFrame({"source": s, "node": g.ids[keep], "cost": [best[u] for u in keep], "distance_m": [metres[u] for u in keep]})

    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], f"source {kind}")
    found, rest = in_parts(edges, asked, weight, search, f"source {kind}, node {kind}, cost double, distance_m double")
    if rest is None:
        return found
    large = relax(rest[0], rest[1].select(F.col("source").alias("id")), weight, bound, metres=True, narrow=False)
    return large if found is None else found.unionByName(large)


def relax(edges: DataFrame, sources: list | DataFrame, weight: str = "time_s", bound: float = float("inf"), max_rounds: int = 10_000, metres: bool = False, tree: bool = False, narrow: bool = True) -> DataFrame:
    """(source, node, cost): the same costs by relaxation joins, for graphs of any size; a round's rows are a folder of their own.

    With ``metres`` also distance_m, of equally cheap paths that of the
    shortest. With ``tree`` also prev, the node before on the cheapest path
    (null at the source). Sources are a list, or a table with a column id. Of
    more than MAX_EDGES edges those that the sources reach are taken first.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    sums = {"cost": weight} | ({"distance_m": "distance_m"} if metres else {})
    more = ["prev"] if tree else []
    if isinstance(sources, list):
        sources = spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], f"id {kind}")
    if narrow and edges.count() > MAX_EDGES and (found := narrowed(edges, sources)):
        edges = found[0]
    least = lambda t, keys, cols: t.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("b")).select(*keys, *(F.col(f"b.{c}").alias(c) for c in cols))
    e = least(edges.select("src", "dst", *(F.col(w).alias(c) for c, w in sums.items())), ["src", "dst"], list(sums)).select("src", "dst", *(F.col(c).alias(f"w_{c}") for c in sums))
    e = stored(e)
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct().join(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")
    start = start.select("source", "node", *(F.lit(0.0).alias(c) for c in sums), *([F.lit(None).cast(kind).alias("prev")] if tree else []))
    step_more = [F.col("src").alias("prev")] if tree else []
    path, no, total = scratch(spark, "relax"), 0, 0
    read = spark.read.schema(start.schema).option("recursiveFileLookup", "true")
    start.write.parquet(f"{path}/0")
    # a row replaces those before it, since its cost is smaller; edges of cost 0 cannot turn a tree into a loop
    best = lambda: least(read.parquet(path), ["source", "node"], [*sums, *more])
    while no < max_rounds:
        fresh = read.parquet(f"{path}/{no}")
        n = fresh.count()
        if not n:
            break
        total, no = total + n, no + 1
        step = _sent(fresh.withColumnRenamed("node", "src"), n).join(e, "src").select("source", F.col("dst").alias("node"), *((F.col(c) + F.col(f"w_{c}")).alias(c) for c in sums), *step_more).where(F.col("cost") <= bound)
        old = best().select("source", "node", F.struct(*sums).alias("old"))
        newer = least(step, ["source", "node"], [*sums, *more]).join(_sent(old, total), ["source", "node"], "left").where(F.col("old").isNull() | (F.struct(*sums) < F.col("old")))
        newer.select("source", "node", *sums, *more).write.parquet(f"{path}/{no}")
    return stored(best())


def _line(edges: DataFrame, weight: str) -> list[str]:
    """The order among parallel edges: the cheapest, then by way and place."""
    return [weight, "way_id", "pos"]


def joined_steps(edges: DataFrame, legs: DataFrame, weight: str = "time_s", narrow: bool = True) -> DataFrame:
    """The step table of (leg, source, target) rows on a graph of any size; a leg without a path has no steps."""
    tree = relax(edges, legs.select(F.col("source").alias("id")).distinct(), weight, tree=True, narrow=narrow)
    on = reached = cut(legs.select("leg", "source", F.col("target").alias("node"), F.lit(0).alias("back")).join(tree.select("source", "node"), ["source", "node"], "left_semi"))
    jump, far = stored(tree.where("prev is not null").select("source", "node", "prev")), 1
    while on.take(1):  # reached: what lies less than ``far`` steps before a target; jump: ``far`` steps back
        on = cut(reached.join(jump, ["source", "node"]).select("leg", "source", F.col("prev").alias("node"), (F.col("back") + far).alias("back")))
        reached = cut(reached.unionByName(on))
        hop = jump.select("source", F.col("node").alias("prev"), F.col("prev").alias("further"))
        jump, far = stored(jump.join(hop, ["source", "prev"]).select("source", "node", F.col("further").alias("prev"))), 2 * far
    last = reached.groupBy("leg").agg(F.max("back").alias("last"))
    path = cut(reached.join(last, "leg").join(tree, ["source", "node"]).where("prev is not null").select("leg", (F.col("last") - 1 - F.col("back")).alias("seq"), F.col("prev").alias("src"), F.col("node").alias("dst")))
    cols = ["way_id", "highway", "name", "distance_m", "time_s"]
    line = edges.join(_sent(path.select("src", "dst").distinct(), path.count()), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min_by(F.struct(*cols), F.struct(*_line(edges, weight))).alias("l"))
    return path.join(line, ["src", "dst"]).select("leg", "seq", "src", "dst", *(F.col(f"l.{c}").alias(c) for c in cols))


def reach(edges: DataFrame, sources: list, weight: str = "time_s", bound: float = float("inf")) -> DataFrame:
    """costs() by its older name."""
    return costs(edges, sources, weight, bound)


def _snapped(m: GeoMap, edges: DataFrame, points: list[tuple[float, float]]) -> list:
    """The nearest node of the graph to each (lat, lon)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(m.coords, "id")
    return spatial.snap(nodes, points)


def _step_table(spark: SparkSession, edges: DataFrame, steps: list[tuple]) -> DataFrame:
    kind = dict(edges.dtypes)
    return spark.createDataFrame(steps, f"leg int, seq int, src {kind['src']}, dst {kind['dst']}, way_id {kind['way_id']}, highway string, name string, distance_m double, time_s double")


def _paths(edges: DataFrame, asked: DataFrame, weight: str, find, joined) -> DataFrame:
    """The step table of ``find`` (see ``met``) for every row of ``asked`` (pair, source, target), in the workers, and of ``joined(edges, rows)`` for those whose part of the graph is too large."""
    kind = dict(edges.dtypes)

    def search(g: Graph, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for row in pdf.to_dict("records"):
            for leg, path in find(g, row, float("inf"))[0]:
                at = [g.origin(k) for k in path]
                yield pd.DataFrame({"leg": leg, "seq": range(len(path)), "src": g.ids[at], "dst": g.ids[g.to[path]], "way_id": g.way[path], "pos": g.pos[path]})

    keys = ["src", "dst", "way_id", "pos"]
    near, rest = None, None
    if edges.count() > MAX_EDGES:
        near, asked = met(edges, asked, weight, find)
        near = near.where("seq >= 0").select("leg", "seq", *keys)
    if near is None or asked.take(1):
        found, rest = in_parts(edges, asked, weight, search, "leg int, seq int, " + ", ".join(f"{c} {kind[c]}" for c in keys))
        found = near if found is None else found if near is None else found.unionByName(near)
    else:
        found = near
    cols = ["leg", "seq", "src", "dst", "way_id", "highway", "name", "distance_m", "time_s"]
    large = None if rest is None else joined(*rest).select(*cols)
    if found is None:
        return large
    whole = edges.join(F.broadcast(cut(found)), ["src", "dst", "way_id", "pos"]).select(*cols)  # a few paths
    return whole if large is None else whole.unionByName(large)


def route_nodes(edges: DataFrame, stops: list, weight: str = "time_s") -> DataFrame:
    """(leg, seq, src, dst, way_id, highway, name, distance_m, time_s) of the cheapest path over given nodes in order; empty if a leg has none."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    pairs = list(zip(stops, stops[1:], strict=False))
    legs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"pair int, source {kind}, target {kind}")
    steps = cut(_paths(edges, legs, weight, _cheapest, lambda e, rows: joined_steps(e, rows.withColumnRenamed("pair", "leg"), weight, narrow=False)))
    there = steps.select("leg").distinct().count()  # a leg from a node to itself needs no step
    return steps if there == sum(a != b for a, b in pairs) else _step_table(spark, edges, [])


def route(m: GeoMap, points: list[tuple[float, float]], mode: str = "drive", optimize: str = "time", fix_reverse: bool = True) -> DataFrame:
    """The steps of a route over (lat, lon) points in order; empty if there is none."""
    edges = stored(network.edges(m, mode, fix_reverse=fix_reverse))
    return route_nodes(edges, _snapped(m, edges, points), "time_s" if optimize == "time" else "distance_m")


def legs(steps: DataFrame) -> DataFrame:
    """(leg, distance_m, time_s, n_steps) of a route."""
    return steps.groupBy("leg").agg(F.sum("distance_m").alias("distance_m"), F.sum("time_s").alias("time_s"), F.count(F.lit(1)).alias("n_steps")).orderBy("leg")


def directions(steps: DataFrame, coords: DataFrame, angle: float = 30.0) -> DataFrame:
    """(no, instruction, name, distance_m, time_s): steps grouped into instructions.

    A new one begins where the street changes or the bearing turns by more than
    ``angle`` (wrapped to half a turn); the last one is the arrival. Two windows
    over the steps of one route: gaps and islands.
    """
    a, b = (coords.select(F.col("id").alias(k), F.struct("lon", "lat").alias(f"p_{k}")) for k in ("src", "dst"))
    rows = steps.join(a, "src").join(b, "dst").withColumn("b", geo.bearing(geo.lonlat(F.col("p_src")), geo.lonlat(F.col("p_dst")))).withColumn("street", F.coalesce("name", "highway"))
    w = Window.orderBy("leg", "seq")  # one route
    turned = F.pmod(F.col("b") - F.lag("b").over(w) + 540, F.lit(360.0)) - 180
    rows = rows.withColumn("turn", turned).withColumn("new", F.lag("street").over(w).isNull() | (F.col("street") != F.lag("street").over(w)) | (F.abs("turn") > angle))
    rows = rows.withColumn("no", F.sum(F.col("new").cast("int")).over(w))
    out = rows.groupBy("no").agg(F.min_by("turn", F.struct("leg", "seq")).alias("t"), F.first("street").alias("name"), F.sum("distance_m").alias("distance_m"), F.sum("time_s").alias("time_s"))
    out = out.select("no", F.when(F.col("t").isNull(), F.concat(F.lit("Start on "), "name")).otherwise(F.concat(units.turn(F.col("t")), F.lit(" onto "), F.col("name"))).alias("instruction"), "name", "distance_m", "time_s")
    end = out.agg((F.max("no") + 1).alias("no")).select("no", F.lit("Arrive at destination").alias("instruction"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("time_s"))
    return out.unionByName(end).orderBy("no")


def _joined_alternatives(edges: DataFrame, a, b, count: int, weight: str, too_alike: float) -> DataFrame:
    """alternatives() by joins; the driver keeps the keys of the paths found, nothing of the graph."""
    kind = dict(edges.dtypes)
    key = ["src", "dst", "way_id", "pos"]
    legs = edges.sparkSession.createDataFrame([(0, a, b)], f"leg int, source {kind['src']}, target {kind['src']}")
    factor: dict[tuple, float] = {}
    found: list[set] = []
    out = _step_table(edges.sparkSession, edges, [])
    for _ in range(max(1, 4 * count)):
        if len(found) >= count:
            break
        dearer = edges.sparkSession.createDataFrame([(*k, v) for k, v in factor.items()], ", ".join(f"{c} {kind[c]}" for c in key) + ", factor double")
        priced = cut(edges.join(F.broadcast(dearer), key, "left").withColumn("price", F.col(weight) * F.coalesce("factor", F.lit(1.0))).drop("factor"))  # edges of paths found
        steps = cut(joined_steps(priced, legs, "price", narrow=False))
        line = priced.join(steps.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min_by(F.struct("way_id", "pos"), F.struct("price", "way_id", "pos")).alias("k"))
        path = {(r["src"], r["dst"], r["k"]["way_id"], r["k"]["pos"]) for r in line.collect()}  # one path
        if not path:
            break
        alike = any(len(path & p) / len(path) > too_alike for p in found)
        for k in path:
            factor[k] = factor.get(k, 1.0) * (4 if alike else 2)
        if not alike:
            out = out.unionByName(steps.withColumn("leg", F.lit(len(found))))
            found.append(path)
    return out.withColumnRenamed("leg", "route")


def alternatives(edges: DataFrame, a, b, count: int = 3, weight: str = "time_s", too_alike: float = 0.8) -> DataFrame:
    """(route, seq, src, dst, ...): the best path and others found by penalising the edges used so far (twice, four times if a path is too alike)."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]

    def find(g: Graph, row, within: float) -> tuple[list[tuple[int, list[int]]], float]:
        i, j = g.index(row["source"]), g.index(row["target"])
        cost, found, dearest = g.cost.copy(), [], 0.0
        for _ in range(max(1, 4 * count)):
            if i < 0 or j < 0 or len(found) >= count:
                break
            best, via = g.tree(i, {j}, cost=cost)
            if j not in best:
                break
            dearest = max(dearest, best[j])
            if dearest > within:  # edges dearer by then may hide a better path; what follows depends on this one
                break
            path = g.path(via, j)
            alike = any(len(set(path) & set(p)) / max(1, len(path)) > too_alike for p in found)
            cost[path] *= 4 if alike else 2
            if not alike:
                found.append(path)
        return list(enumerate(found)), dearest

    joined = lambda e, _: _joined_alternatives(e, a, b, count, weight, too_alike).withColumnRenamed("route", "leg")
    return _paths(edges, spark.createDataFrame([(0, a, b)], f"pair int, source {kind}, target {kind}"), weight, find, joined).withColumnRenamed("leg", "route")


def distance_matrix(edges: DataFrame, nodes: list, weight: str = "time_s") -> DataFrame:
    """(origin, destination, time_s or cost, distance_m): all pairs of given nodes; null where there is no path; distance_m is that of the cheapest path."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    points = spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], f"n {kind}")  # the caller's list
    pairs = points.withColumnRenamed("n", "origin").crossJoin(points.withColumnRenamed("n", "destination"))
    n = len(set(nodes))
    if n * n > PAIRS or edges.count() <= MAX_EDGES:
        found = reach(edges, nodes, weight).withColumnRenamed("node", "target")
    else:
        each = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in dict.fromkeys(nodes) for b in dict.fromkeys(nodes))]
        found = pair_costs(edges, spark.createDataFrame(each, f"pair int, source {kind}, target {kind}"), weight)
    return pairs.join(found.select(F.col("source").alias("origin"), F.col("target").alias("destination"), "cost", "distance_m"), ["origin", "destination"], "left").select("origin", "destination", "cost", "distance_m")


def isochrone(m: GeoMap, lat: float, lon: float, minutes: list[float], mode: str = "walk", bins: int = 36) -> tuple[DataFrame, DataFrame]:
    """(reached: node, cost, lat, lon, zone; rings: zone, bin, lon, lat): what is in reach, by the smallest time that covers it, and outlines."""
    edges = stored(network.edges(m, mode))
    start = _snapped(m, edges, [(lat, lon)])[0]
    limits = sorted(minutes)
    zone = F.lit(None).cast("double")
    for t in reversed(limits):
        zone = F.when(F.col("cost") <= t * 60, float(t)).otherwise(zone)
    reached = cut(reach(edges, [start], "time_s", bound=limits[-1] * 60).select(F.col("node").alias("id"), "cost").join(m.coords, "id").withColumn("zone", zone))
    center = m.coords.where(F.col("id") == start).first()
    rings = None
    for t in limits:
        r = geometry.radial_ring(reached.where(F.col("cost") <= t * 60), center["lon"], center["lat"], bins).withColumn("zone", F.lit(float(t)))
        rings = r if rings is None else rings.unionByName(r)
    return reached, rings


def _walks(pois: DataFrame, nodes: DataFrame, walk_in: float, speed: float) -> DataFrame:
    """``pois`` with cost_s, a node's cost and the walk from it, for nodes within ``walk_in`` metres: of each POI its least one, and others.

    Both sides are put into small cells. From cells that lie within ``walk_in`` of
    all POIs of a cell their least cost and the longest walk bound what these
    POIs can cost; of every cell around only nodes that can be cheaper than
    that meet the POIs, so pairs do not grow with all nodes around.
    """
    step = walk_in / CELLS / 111_000
    row = F.floor(F.col("lat") / step)
    col = F.floor(F.col("lon") * F.greatest(F.lit(1e-3), F.cos(F.radians((row + 0.5) * step))) / step)
    meters = lambda a, b: geo.haversine((F.col(f"{a}lon"), F.col(f"{a}lat")), (F.col(f"{b}lon"), F.col(f"{b}lat")))

    def cells(df: DataFrame, *more) -> DataFrame:
        """(cy, cx, lat, lon, far): a middle of each cell's rows, and how far they are from it at most."""
        middle = df.groupBy("cy", "cx").agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
        rows = df.join(middle, ["cy", "cx"]).withColumn("far", meters("", "m_") + 0.01)
        return cut(rows.groupBy("cy", "cx").agg(F.first("m_lat").alias("lat"), F.first("m_lon").alias("lon"), F.max("far").alias("far"), *more))

    pois, nodes = (stored(df.withColumn("cy", row).withColumn("cx", col)) for df in (pois, nodes))
    left, right = cells(pois), cells(nodes, F.min("cost").alias("least"))
    widest = sum(c.agg(F.coalesce(F.max("far"), F.lit(0.0))).first()[0] for c in (left, right))
    near, both = spatial.within_distance(left, right, walk_in + widest), F.col("l_far") + F.col("r_far")
    walk = F.when(F.col("distance_m") + both <= walk_in, F.col("r_least") + (F.col("distance_m") + both) / speed)
    near = near.where(F.col("distance_m") - both <= walk_in).withColumn("most", F.min(walk).over(Window.partitionBy("l_cy", "l_cx")))
    near = near.select("l_cy", "l_cx", F.col("r_cy").alias("cy"), F.col("r_cx").alias("cx"), "r_least", (F.coalesce("most", F.lit(float("inf"))) - F.greatest(F.lit(0.0), F.col("distance_m") - both) / speed + 1e-6).alias("most")).where("r_least <= most")
    some = nodes.join(near, ["cy", "cx"]).where("cost <= most").select(F.col("l_cy").alias("cy"), F.col("l_cx").alias("cx"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "cost")
    out = spatial.dealt_join(pois, stored(some), ["cy", "cx"]).withColumn("distance_m", meters("", "r_"))
    return out.where(F.col("distance_m") <= walk_in).withColumn("cost_s", F.col("cost") + F.col("distance_m") / speed)


def catchment(m: GeoMap, lat: float, lon: float, minutes: list[float], mode: str = "walk", walk_in: float = 500.0) -> DataFrame:
    """(id, category, name, cost_s, zone): POIs with the least travel plus walk (5 km/h) from a reached node within ``walk_in`` metres, in their smallest zone."""
    reached, _ = isochrone(m, lat, lon, minutes, mode)
    tags, spec = F.col("tags"), SPECS["catchment_poi"]
    pois = m.nodes.where(T.column(spec.where, tags)).select("id", "lat", "lon", T.column(spec.kind, tags).alias("category"), tags["name"].alias("name"))
    pairs = _walks(pois, reached.select("id", "lat", "lon", "cost"), walk_in, 5000 / 3600)
    per = pairs.groupBy("id", "category", "name").agg(F.min("cost_s").alias("cost_s"))
    zone = F.lit(None).cast("double")
    for t in sorted(minutes, reverse=True):
        zone = F.when(F.col("cost_s") <= t * 60, float(t)).otherwise(zone)
    return per.withColumn("zone", zone).where("zone is not null")
