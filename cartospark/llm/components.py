"""Connected components by repeated contraction, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of ``edges``; root is the smallest vertex that v reaches.

    Each round points every vertex at its smallest neighbour, follows the
    pointers to their ends by doubling and contracts the graph to these ends, so
    a component loses at least half of its vertices a round. Every round's tables
    are checkpointed. Null ends and self-loops are ignored; an empty input
    gives an empty result; repeated edges count once.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = cut(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(live.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.col("v")))
    while live.take(1):
        point = (
            live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))).alias("e"))
            .groupBy("e.v").agg(F.min("e.to").alias("to"))
            .select("v", F.least("v", "to").alias("to"))
        )
        point, moved = cut(point), True
        while moved:
            nxt = point.select(F.col("v").alias("to"), F.col("to").alias("nxt"))
            point = stored(point.join(nxt, "to", "left").select("v", F.coalesce("nxt", "to").alias("to"), (F.coalesce("nxt", "to") != F.col("to")).alias("moved")))
            moved = bool(point.where("moved").take(1))
            point = point.select("v", "to")
        labels = cut(labels.join(point.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root")))
        left, right = (point.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        live = live.join(left, "a").join(right, "b").where("a_to <> b_to")
        live = cut(live.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return labels
