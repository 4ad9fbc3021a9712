"""Near-duplicate vectors of a label by cross-polytope hashing.

A hash function turns a vector at random by three rounds of random signs and a
fast Hadamard transform and takes the axis that it then lies nearest to (2 * dim
values). A table joins K functions. A vector lives in one bucket of each table
and visits the PROBES next likely ones; a pair is a candidate where one of the
two lives and the other lives or visits. K follows the number of vectors, so
that a bucket holds about BUCKET of unrelated ones, and the number of tables is
as many as find RECALL of pairs exactly at the threshold, measured beforehand on
random pairs at that angle (the chance depends on the angle alone).

Nothing is quadratic in a group of copies: equal vectors are one node with a
number of copies, and nodes within half of the threshold's angle of one leader
(the smallest node of a bucket) form a ball, all pairs of which are links by the
triangle inequality; these are counted by the ball's weight. Every other
candidate pair is verified by its cosine, block against block inside its bucket;
blocks of one ball do not meet. A block task returns a number of links a vector
and the edges of a spanning forest, never pairs; a pair that meets in several
buckets counts in the first one only, which both signatures tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small, spread_join
from .components import components

#: Visited buckets of a table, beside the own one.
PROBES = 3
#: Share of pairs at the threshold that the tables have to find.
RECALL = 0.9995
#: Unrelated vectors in a bucket, about.
BUCKET = 4096
#: Vectors in a block of verification.
BLOCK = 1024
MAX_TABLES = 64
SEED = 13


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def codes(x: np.ndarray, functions: int, table: int, probes: int = PROBES) -> np.ndarray:
    """(row, 1 + probes) codes of unit rows in a table: the own bucket first, then the visited ones by rising loss; -1 where there are no more."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.hstack([x, np.zeros((n, width - dim))])
    take = min(probes + 1, width)
    code, loss = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for k in range(functions):
        y, draw = x, np.random.default_rng([SEED, table, k, width])
        for _ in range(3):
            y = hadamard(y * draw.choice([-1.0, 1.0], size=width))
        size = np.abs(y)
        axes = np.argsort(-size, axis=1, kind="stable")[:, :take]
        best = np.take_along_axis(size, axes, 1)
        axis = 2 * axes + (np.take_along_axis(y, axes, 1) < 0)
        both = (loss[:, :, None] + (best[:, None, :1] - best[:, None, :]) ** 2).reshape(n, -1)
        joint = (code[:, :, None] * (2 * width) + axis[:, None, :]).reshape(n, -1)
        keep = np.argsort(both, axis=1, kind="stable")[:, : probes + 1]
        code, loss = np.take_along_axis(joint, keep, 1), np.take_along_axis(both, keep, 1)
    out = np.full((n, probes + 1), -1, dtype=np.int64)
    out[:, : code.shape[1]] = code
    return out


def signature(x: np.ndarray, functions: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(row, table, 1 + probes) codes."""
    return np.stack([codes(x, functions, t, probes) for t in range(tables)], axis=1)


def meets(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, table): does q live or visit where p lives, and the other way round."""
    return (p[:, :, :1] == q).any(2), (q[:, :, :1] == p).any(2)


def tables_for(dim: int, functions: int, min_cos: float, recall: float = RECALL, pairs: int = 4000) -> int:
    """Tables that find ``recall`` of random pairs at the threshold, MAX_TABLES at most; the same number on every run."""
    draw = np.random.default_rng([SEED, dim, functions])
    a, b = draw.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = min_cos * a + math.sqrt(1 - min_cos * min_cos) * b
    found = np.zeros(pairs, dtype=bool)
    for t in range(MAX_TABLES):
        here, there = meets(codes(a, functions, t)[:, None], codes(b, functions, t)[:, None])
        found |= (here | there)[:, 0]
        if found.mean() >= recall:
            return t + 1
    return MAX_TABLES


def unit(lists: pa.Array) -> np.ndarray:
    """The lists, all of one length, as rows of length 1 in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, key): equal vectors of a label share a 128-bit key; it is null for those that link with nothing."""
    x, label = F.col("embedding"), F.col("label")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    key = F.concat_ws(":", *(F.hex(F.xxhash64(F.lit(i), label, x)) for i in (1, 2)))
    return vectors.select("vec_id", "label", "embedding").withColumn("key", F.when(label.isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)), key))


def signed(nodes: DataFrame, min_cos: float) -> tuple[DataFrame, int]:
    """Nodes with their signatures (tables * (PROBES + 1) codes), and the number of tables."""
    sizes = nodes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dims = sizes.groupBy("dim").agg(F.max("n").alias("n")).collect()  # one row a length of vectors
    plan = {}
    for r in dims:
        width = 2 * (1 << max(1, (r["dim"] - 1).bit_length()))
        functions = max(1, math.ceil(math.log(max(1.0, r["n"] / BUCKET), width)))
        plan[r["dim"]] = functions, tables_for(r["dim"], functions, min_cos)
    tables = max([t for _, t in plan.values()], default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            lengths = e.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = b.filter(pa.array(lengths == dim))
                functions, own = plan[int(dim)]
                s = np.full((len(part), tables, PROBES + 1), -1, dtype=np.int64)
                s[:, :own] = signature(unit(part.column("embedding")), functions, own)
                step = tables * (PROBES + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * step + 1, step, dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "sig"])

    kinds = ", ".join(f"{c} {k}" for c, k in nodes.dtypes)
    return nodes.mapInArrow(run, f"{kinds}, sig array<long>"), tables


def near_leaders(nodes: DataFrame, tables: int, min_cos: float, n: int) -> DataFrame:
    """(node, ball): the smallest node among those of a node's own buckets within half of the threshold's angle."""
    own = nodes.select("node", "label", F.size("embedding").alias("dim"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.get("sig", t * (PROBES + 1)))).alias("t", "code"))
    own = own.where("code >= 0").select("node", F.concat_ws("|", "label", "dim", "t", "code").alias("bucket"))
    low = own.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    asked = spread_join(own, low, "bucket", n * tables).where("leader < node").select("node", "leader").distinct()
    asked = cut(asked)
    asked = asked.join(nodes.select("node", F.col("embedding").alias("x")), "node")
    asked = spread_join(asked, nodes.select(F.col("node").alias("leader"), F.col("embedding").alias("y")), "leader", n * tables)
    least = math.cos(math.acos(min_cos) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = b.filter(pa.array(lengths == dim))
                near = (unit(part.column("x")) * unit(part.column("y"))).sum(1) >= least
                yield part.select(["node", "leader"]).filter(pa.array(near))

    return asked.select("node", "leader", "x", "y").mapInArrow(run, "node long, leader long").groupBy("node").agg(F.min("leader").alias("ball"))


def placed(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, copies, ball, embedding, sig, t, code, blk, task, cross): every node once in each task that has to see it.

    A bucket of up to BLOCK entries is a task. A larger one is dealt into blocks,
    those of a ball of over BLOCK entries apart from the rest, and a task is a
    pair of blocks (cross), never of one ball, or a block of the rest with itself.
    """
    at = F.posexplode("sig").alias("i", "code")
    entries = nodes.select("node", "copies", "ball", "label", F.size("embedding").alias("dim"), "embedding", "sig", at).where("code >= 0")
    entries = entries.withColumn("t", F.floor(F.col("i") / (PROBES + 1)).cast("int"))
    entries = entries.withColumn("bucket", F.concat_ws("|", "label", "dim", "t", "code")).select("node", "copies", "ball", "embedding", "sig", "t", "code", "bucket")
    counts = cut(entries.groupBy("bucket", "ball").agg(F.count(F.lit(1)).alias("n")).withColumn("big", F.col("n") > BLOCK).groupBy("bucket", F.when(F.col("big"), F.col("ball")).alias("sub")).agg(F.sum("n").alias("n")))
    crowded = counts.groupBy("bucket").agg(F.sum("n").alias("all")).where(F.col("all") > BLOCK).select("bucket")
    groups = cut(counts.join(crowded, "bucket", "left_semi").select("bucket", "sub", F.ceil(F.col("n") / BLOCK).alias("g")))
    n_groups = groups.count()  # a bucket has over BLOCK entries, so these are few
    hot = small(groups.select("bucket").distinct(), n_groups)
    calm = entries.join(hot, "bucket", "left_anti").withColumns({"blk": F.lit(""), "task": F.col("bucket"), "cross": F.lit(False)})
    blocks = groups.select("bucket", "sub", F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)).alias("no")).withColumn("blk", F.concat_ws("/", "sub", "no"))
    one, other = blocks.select("bucket", "sub", F.col("blk").alias("a")), blocks.select("bucket", F.col("sub").alias("sub2"), F.col("blk").alias("b"))
    pairs = one.join(other, "bucket").where("a <= b and not (sub is not null and sub <=> sub2)")
    pairs = cut(pairs.select("bucket", F.explode(F.array_distinct(F.array("a", "b"))).alias("blk"), F.concat_ws("~", "bucket", "a", "b").alias("task"), (F.col("a") != F.col("b")).alias("cross")))
    balls = small(groups.where("sub is not null").select("bucket", F.col("sub").alias("ball"), F.col("g").alias("g_ball")), n_groups)
    rest = small(groups.where("sub is null").select("bucket", F.col("g").alias("g_rest")), n_groups)
    dealt = entries.join(hot, "bucket", "left_semi").join(balls, ["bucket", "ball"], "left").join(rest, "bucket", "left")
    no = F.pmod(F.xxhash64("node"), F.coalesce("g_ball", "g_rest").cast("long"))
    dealt = dealt.withColumn("blk", F.concat_ws("/", F.when(F.col("g_ball").isNotNull(), F.col("ball")), no)).drop("g_ball", "g_rest")
    return calm.unionByName(dealt.join(small(pairs, pairs.count()), ["bucket", "blk"]).select(calm.columns))


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a and b, pair by pair; a set is named by its smallest member."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def verified(part: pa.Table, min_cos: float, tables: int, rows: int = 256, at_once: int = 1 << 15) -> pa.Table:
    """(node, links, peer) of one task: how many vectors each links with here, and one that it hangs together with."""
    node, copies, ball, code, t = (part.column(c).to_numpy() for c in ("node", "copies", "ball", "code", "t"))
    blk = np.unique(np.array(part.column("blk").to_pylist()), return_inverse=True)[1]
    n = len(node)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    if n > 1 and (ball != ball[0]).any():
        x = unit(part.column("embedding").combine_chunks())
        sig = part.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, tables, PROBES + 1)
        cross = part.column("cross")[0].as_py()
        for i in range(0, n, rows):
            near = x[i : i + rows] @ x.T >= min_cos
            near &= ball[i : i + rows, None] != ball
            near &= (blk[i : i + rows, None] < blk) if cross else (np.arange(i, min(i + rows, n))[:, None] < np.arange(n))
            a, b = np.nonzero(near)
            a += i
            for k in range(0, len(a), at_once):
                u, v = a[k : k + at_once], b[k : k + at_once]
                here, there = meets(sig[u], sig[v])
                first = (here | there).argmax(1)
                at = np.arange(len(u))
                own, its = sig[u, first, 0], sig[v, first, 0]
                place = np.where(here[at, first] & there[at, first], np.minimum(own, its), np.where(here[at, first], own, its))
                counts = (first == t[u]) & (place == code[u])
                u, v = u[counts], v[counts]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                root = merged(root, u, v)
    told = links > 0
    return pa.table({"node": node[told], "links": links[told], "peer": node[root[told]]})


def near_duplicates(vectors: DataFrame, min_cos: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors are compared if their labels are equal and not null and their lengths
    are equal; null, empty and zero vectors and those with null or non-finite
    components link with nothing, their component is themselves. Repeated rows
    are vectors of their own and link with each other. Rows without vec_id link
    like others, name no component and are not kept. An empty table gives an
    empty result; extra columns play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = keyed(vectors)
    nodes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    nodes, tables = signed(nodes, min_cos)
    nodes = cut(nodes)
    n = nodes.count()
    balls = near_leaders(nodes, tables, min_cos, n)
    nodes = cut(nodes.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", "node")))
    shown = placed(nodes.select("node", "copies", "ball", "label", "embedding", "sig"), tables)
    found = shown.select("task", "node", "copies", "ball", "embedding", "sig", "t", "code", "blk", "cross").groupBy("task").applyInArrow(lambda part: verified(part, min_cos, tables), "node long, links long, peer long")
    found = cut(found)
    weights = nodes.groupBy("ball").agg(F.sum("copies").alias("weight"))
    light = spread_join(nodes.select("node", "key", "id", "ball"), weights, "ball", n)
    light = light.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    light = light.select("node", "key", "id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    edges = found.select(F.col("node").alias("a"), F.col("peer").alias("b")).unionByName(nodes.select(F.col("node").alias("a"), F.col("ball").alias("b"))).where("a <> b")
    light = cut(light.join(components(edges).withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = light.groupBy("root").agg(F.min("id").alias("component_id"))
    light = spread_join(light, names, "root", n).select("key", "n_links", "component_id")
    out = spread_join(rows.select("vec_id", "key"), light, "key", vectors.count())
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
