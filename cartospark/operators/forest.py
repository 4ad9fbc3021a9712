"""Spanning forests, tree orders and blocks of graphs of any size, by joins alone.

Bridges and cut nodes need a depth-first order only in one task. Any rooted
spanning tree does as well (after Tarjan and Vishkin): number its nodes in
preorder, find for each subtree the smallest and largest number that an edge
outside the tree leads to, and join tree edges whose subtrees reach past each
other; what hangs together is a block. A forest comes from repeated contraction
along each part's smallest edge, its root and order from the tour around the
tree, ranked by pointer doubling, and subtrees are intervals of the order. So
the rounds grow with the logarithm of the graph, whatever its shape, and no task
holds more than BLOCK nodes together.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, stored
from . import network

#: Nodes of the order that a task looks at together.
BLOCK = 4096
_ROW_BITS = 33


def in_order(rows: DataFrame, *cols: str, name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of some columns that make them unique; ranges are sorted apart."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _ROW_BITS)
    sizes = dict(dealt.groupBy(part.alias("p")).count().collect())  # one row a range
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    before = F.broadcast(spark.createDataFrame(starts, "_p long, _before long"))
    place = F.col("_m") - F.shiftleft("_p", _ROW_BITS) + F.col("_before")
    return dealt.join(before, part == F.col("_p")).withColumn(name, place).drop("_m", "_p", "_before")


def spanning_forest(simple: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of a simple graph (a < b): every round each part keeps its smallest edge to another part."""
    live = cut(simple.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"))
    forest = None
    while live.take(1):
        ways = F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("w")
        pick = live.select("a", "b", ways).groupBy(F.col("w.x").alias("x")).agg(F.min(F.struct("a", "b", "w.y")).alias("e"))
        pick = cut(pick.select("x", "e.y", "e.a", "e.b"))
        kept = pick.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"))
        forest = kept.select("a", "b") if forest is None else forest.unionByName(kept.select("a", "b"))
        # two parts that keep the same edge would point at each other: the smaller one stays
        point, moved = cut(pick.join(kept, ["a", "b"]).select("x", F.when((F.col("n") == 2) & (F.col("low") == F.col("x")), F.col("x")).otherwise(F.col("y")).alias("to"))), True
        while moved:
            hop = point.select(F.col("x").alias("to"), F.col("to").alias("hop"))
            point = stored(point.join(hop, "to").select("x", F.col("hop").alias("to"), (F.col("hop") != F.col("to")).alias("moved")))
            moved = bool(point.where("moved").take(1))
            point = point.select("x", "to")
        ends = [point.select(F.col("x").alias(c), F.col("to").alias(f"{c}2")) for c in "uv"]
        live = live.join(ends[0], "u").join(ends[1], "v").where("u2 <> v2")
        live = cut(live.groupBy(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).agg(F.min(F.struct("a", "b")).alias("e")).select("u", "v", "e.a", "e.b"))
    return cut(forest) if forest is not None else simple


def rooted(forest: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, parent, pre, size, component) of a forest's nodes: preorder numbers over all trees, and nodes in each subtree.

    ``parts`` is (id, component), each tree's root the node that names it. The
    tour goes from an edge into a node to the next edge out of it; its places
    are counted by doubling.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    arcs = cut(in_order(forest.select(ends.alias("w")).select("w.u", "w.v"), "u", "v", name="i"))
    bounds = cut(arcs.groupBy("u").agg(F.min("i").alias("first"), F.max("i").alias("last")))
    turn = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("i").alias("back"))
    wrap = bounds.select(F.col("last").alias("back"), "first")
    roots = bounds.join(parts.where("id = component").select(F.col("id").alias("u")), "u").select(F.col("first").alias("next"), F.lit(True).alias("end"))
    tour = arcs.join(turn, ["u", "v"]).join(wrap, "back", "left").withColumn("next", F.coalesce("first", F.col("back") + 1)).join(roots, "next", "left")
    # a finished tour points below 0, at a place of its own, so that no key gathers them
    tour = cut(tour.select("u", "v", "i", F.when(F.col("end"), -1 - F.col("i")).otherwise(F.col("next")).alias("next"), F.when(F.col("end"), 0).otherwise(1).cast("long").alias("left")))
    rank = tour.select("i", "next", "left")
    for _ in range(ceil(log2(max(2, tour.count())))):
        hop = rank.select(F.col("i").alias("next"), F.col("next").alias("hop"), F.col("left").alias("more"))
        rank = stored(rank.join(hop, "next", "left").select("i", F.coalesce("hop", "next").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    placed = tour.select("u", "v", "i").join(rank.select("i", "left"), "i").select("u", "v", "left")
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("after"))
    down = placed.join(back, ["u", "v"]).where(F.col("left") > F.col("after"))
    nodes = down.select(F.col("v").alias("id"), F.col("u").alias("parent"), (-F.col("left")).alias("at"), F.shiftright(F.col("left") - F.col("after") + 1, 1).alias("size")).join(parts, "id")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.select(F.col("component").alias("id"), F.lit(None).cast(dict(forest.dtypes)["a"]).alias("parent"), F.lit(-(1 << 62)).alias("at"), "size", "component")
    return in_order(nodes.unionByName(top), "component", "at", name="pre").drop("at")


def _in_blocks(values: DataFrame) -> DataFrame:
    """(v, pre, last, lo, hi, to_lo, to_hi): extremes from each place to its interval's or block's end, and from the block's start to it."""

    def spans(x: np.ndarray, length: np.ndarray, pick) -> np.ndarray:
        """Extremes of x[i : i + length[i]], from a table of powers of two."""
        out, level, table = x.copy(), 0, x
        while True:
            step = 1 << level
            here = (length >= step) & (length < 2 * step)
            at = np.flatnonzero(here)
            out[at] = pick(table[at], table[at + length[at] - step])
            if step * 2 > len(x):
                return out
            table = pick(table[: len(table) - step], table[step:])
            level += 1

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pre")
        pre, last, lo, hi = (part.column(c).to_numpy() for c in ("pre", "last", "lo", "hi"))
        length = np.minimum(last, pre[-1]) - pre + 1
        return pa.table({"pre": pre, "last": last, "lo": spans(lo, length, np.minimum), "hi": spans(hi, length, np.maximum), "to_lo": np.minimum.accumulate(lo), "to_hi": np.maximum.accumulate(hi)})

    ship(values.sparkSession)
    return values.groupBy(F.floor(F.col("pre") / BLOCK).alias("block")).applyInArrow(run, "pre long, last long, lo long, hi long, to_lo long, to_hi long")


def subtree_extremes(values: DataFrame) -> DataFrame:
    """(pre, low, high): extremes of lo and hi over the places pre .. last of each row of (pre, last, lo, hi), pre being 0, 1, 2, ...

    An interval inside a block is looked up there; a longer one has a rest of
    its first block, whole blocks by a table of powers of two, and a beginning
    of its last block.
    """
    near = cut(_in_blocks(values))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    level = cut(values.groupBy(block("pre").alias("b")).agg(F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi")))
    n, step, table = level.count(), 1, level.withColumn("k", F.lit(0))
    k = 0
    while 2 * step <= n:
        k += 1
        ahead = level.select((F.col("b") - step).alias("b"), F.col("b_lo").alias("lo2"), F.col("b_hi").alias("hi2"))
        level = cut(level.join(ahead, "b").select("b", F.least("b_lo", "lo2").alias("b_lo"), F.greatest("b_hi", "hi2").alias("b_hi")))
        table, step = table.unionByName(level.withColumn("k", F.lit(k))), 2 * step
    inside = near.where(block("pre") == block("last")).select("pre", F.col("lo").alias("low"), F.col("hi").alias("high"))
    across = near.where(block("pre") < block("last")).select("pre", "last", "lo", "hi", (block("pre") + 1).alias("b"), block("last").alias("end"))
    tails = near.select(F.col("pre").alias("last"), "to_lo", "to_hi")
    across = across.join(tails, "last").select("pre", "b", "end", F.least("lo", "to_lo").alias("lo"), F.greatest("hi", "to_hi").alias("hi"))
    across = across.withColumn("k", F.length(F.bin(F.greatest(F.col("end") - F.col("b"), F.lit(1)))) - 1)
    second = table.select((F.col("b") + F.expr("shiftleft(1L, k)")).alias("end"), "k", F.col("b_lo").alias("c_lo"), F.col("b_hi").alias("c_hi"))
    whole = across.where("end > b").join(table, ["b", "k"]).join(second, ["end", "k"])
    whole = whole.select("pre", F.least("lo", "b_lo", "c_lo").alias("low"), F.greatest("hi", "b_hi", "c_hi").alias("high"))
    return inside.unionByName(across.where("end = b").select("pre", F.col("lo").alias("low"), F.col("hi").alias("high"))).unionByName(whole)


def weak_points(simple: DataFrame, parts: DataFrame) -> DataFrame:
    """(kind, a, b, pieces) as analysis.weak_points, for a simple graph (a < b) with its components (id, component)."""
    kind = dict(simple.dtypes)["a"]
    forest = spanning_forest(simple)
    nodes = cut(rooted(forest, parts))
    places = nodes.select("id", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))
    ends = [places.select(F.col("id").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("last").alias(f"last_{c}")) for c in "ab"]
    other = cut(simple.join(forest, ["a", "b"], "left_anti").join(ends[0], "a").join(ends[1], "b"))
    met = other.select(F.col("pre_a").alias("pre"), F.col("pre_b").alias("x")).unionByName(other.select(F.col("pre_b").alias("pre"), F.col("pre_a").alias("x")))
    met = met.groupBy("pre").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    values = places.join(met, "pre", "left").select("pre", "last", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    full = cut(nodes.join(subtree_extremes(cut(values)), "pre"))
    above = nodes.select(F.col("id").alias("parent"), F.col("pre").alias("p_pre"), (F.col("pre") + F.col("size") - 1).alias("p_last"), F.col("parent").alias("grand"))
    hung = cut(full.where("parent is not null").join(above, "parent"))
    bridges = hung.where((F.col("low") >= F.col("pre")) & (F.col("high") < F.col("pre") + F.col("size")))
    # tree edges, named by their lower node, that lie on a common cycle
    apart = other.where((F.col("pre_b") > F.col("last_a")) | (F.col("pre_a") > F.col("last_b"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    past = hung.where("grand is not null and (low < p_pre or high > p_last)").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    blocks = network.components(apart.unionByName(past))
    named = hung.select("id", "parent").join(blocks, "id", "left").withColumn("block", F.coalesce("component", "id"))
    at = named.select("id", "block").unionByName(named.select(F.col("parent").alias("id"), "block")).distinct()
    cuts = at.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("pieces")).where("pieces > 0")
    none = F.lit(None)
    return bridges.select(F.lit("bridge").alias("kind"), F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"), none.cast("long").alias("pieces")).unionByName(
        cuts.select(F.lit("articulation").alias("kind"), F.col("id").alias("a"), none.cast(kind).alias("b"), "pieces")
    )
