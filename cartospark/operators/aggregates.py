"""Counts, tag statistics, bounds and rankings. All are partial aggregates on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.filters import key_like, simple
from ..plans.model import GeoMap


def elements(m: GeoMap, kind: str = "all") -> DataFrame:
    """(elem, id, tags) of nodes, ways or both."""
    parts = [d.select(F.lit(e).alias("elem"), "id", "tags") for e, d in (("node", m.nodes), ("way", m.ways)) if kind in ("all", f"{e}s")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count(m: GeoMap, text: str, kind: str = "all") -> DataFrame:
    """(elem, total, matched) of a simple filter."""
    return elements(m, kind).groupBy("elem").agg(F.count(F.lit(1)).alias("total"), F.count_if(simple(text, F.col("tags"))).alias("matched"))


def count_by(m: GeoMap, key: str, text: str | None = None, top: int = 20, kind: str = "all") -> DataFrame:
    """The most frequent values of a key with their share of what is shown; equal counts by value."""
    e = elements(m, kind)
    e = e if text is None else e.where(simple(text, F.col("tags")))
    rows = e.select(F.col("tags")[key].alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return rows.crossJoin(rows.agg(F.sum("n").alias("shown"))).select("value", "n", F.round(100.0 * F.col("n") / F.col("shown"), 2).alias("pct"))


def tag_pairs(m: GeoMap, kind: str = "all") -> DataFrame:
    return elements(m, kind).select(F.explode("tags").alias("key", "value"))


def tag_keys(m: GeoMap, pattern: str | None = None, top: int = 50, rare: bool = False, samples: int = 3, kind: str = "all") -> DataFrame:
    """(key, n, distinct_values, samples): keys by use, with their most frequent values.

    Counted per (key, value) first, so that a key in every element meets as few rows as it has values.
    """
    pairs = tag_pairs(m, kind).groupBy("key", "value").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs if pattern is None else pairs.where(key_like(F.col("key"), pattern))
    order = (F.asc("n") if rare else F.desc("n"), F.asc("key"))
    best = pairs.groupBy("key").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_values")).orderBy(*order).limit(top)
    if not samples:
        return best
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("k"), "value"))
    shown = pairs.join(F.broadcast(best.select("key")), "key").withColumn("r", rank).where(F.col("r") <= samples)  # top keys
    shown = shown.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), "; ").alias("samples"))
    return best.join(shown, "key")


def tag_values(m: GeoMap, key: str, kind: str = "all") -> DataFrame:
    """(value, n) of one key."""
    return elements(m, kind).select(F.col("tags")[key].alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def keys_of_value(m: GeoMap, value: str, kind: str = "all") -> DataFrame:
    """(key, n): which keys carry a value."""
    return tag_pairs(m, kind).where(F.col("value") == value).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def unique_values(m: GeoMap, key: str, min_count: int = 1, sort: str = "count", limit: int | None = None, kind: str = "all") -> DataFrame:
    """(value, n, pct): parts of a multi-valued tag; pct of the elements that have the key."""
    e = elements(m, kind).select(F.col("tags")[key].alias("v")).where("v is not null")
    parts = e.select(F.explode(F.transform(F.split("v", ";"), lambda x: F.trim(x))).alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    out = parts.crossJoin(e.agg(F.count(F.lit(1)).alias("having"))).select("value", "n", F.round(100.0 * F.col("n") / F.col("having"), 2).alias("pct"))
    if sort == "count":
        out = out.orderBy(F.desc("n"), "value")
    elif sort == "alpha":
        out = out.orderBy(F.lower("value"), "value")
    return out if limit is None else out.limit(limit)


def info(m: GeoMap) -> DataFrame:
    """One row: tagged nodes and ways and the bounds of the nodes."""
    nodes = m.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return nodes.crossJoin(m.ways.agg(F.count(F.lit(1)).alias("ways")))


def stats(m: GeoMap) -> DataFrame:
    """One row: all nodes, ways, relations, different keys and values, bounds of all nodes and their centre."""
    bounds = m.coords.agg(F.count(F.lit(1)).alias("nodes"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    pairs = tag_pairs(m)
    if m.relations is not None:
        pairs = pairs.unionByName(m.relations.select(F.explode("tags").alias("key", "value")))
    kinds = pairs.agg(F.countDistinct("key").alias("keys"), F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("tags"))
    relations = m.relations.agg(F.count(F.lit(1)).alias("relations")) if m.relations is not None else m.ways.sparkSession.range(1).select(F.lit(0).cast("long").alias("relations"))
    out = bounds.crossJoin(m.ways.agg(F.count(F.lit(1)).alias("ways"))).crossJoin(relations).crossJoin(kinds)
    return out.withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) / 2).withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2)


def bbox(m: GeoMap, buffer_m: float = 0.0, expand_pct: float = 0.0) -> DataFrame:
    """One row: bounds of the tagged nodes, widened by metres and per cent, with width and height in metres."""
    b = m.nodes.agg(F.min("lat").alias("b"), F.max("lat").alias("t"), F.min("lon").alias("l"), F.max("lon").alias("r"))
    mid = F.cos(F.radians((F.col("b") + F.col("t")) / 2)) * 111320.0
    dy = (F.col("t") - F.col("b")) * expand_pct / 100 + buffer_m / 111320.0
    dx = (F.col("r") - F.col("l")) * expand_pct / 100 + buffer_m / mid
    b = b.select((F.col("b") - dy).alias("min_lat"), (F.col("t") + dy).alias("max_lat"), (F.col("l") - dx).alias("min_lon"), (F.col("r") + dx).alias("max_lon"))
    mid = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)) * 111320.0
    return b.withColumn("height_m", (F.col("max_lat") - F.col("min_lat")) * 111320.0).withColumn("width_m", (F.col("max_lon") - F.col("min_lon")) * mid)


def rollup(rows: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Count and sum of a measure by some columns, largest first."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total")).orderBy(F.desc("total"), *by)


def coverage(rows: DataFrame, **flags: Column) -> DataFrame:
    """One row: how many rows there are, how many satisfy each flag, and their shares in per cent."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return out.select("n", *flags, *(F.round(100.0 * F.col(k) / F.col("n"), 2).alias(f"{k}_pct") for k in flags))


def spread(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, minimum, mean and maximum of a column."""
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("lowest"), F.avg(value).alias("mean"), F.max(value).alias("highest"), F.sum(value).alias("total"))


def ranking(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values of a column; equal counts by value."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def multi_ranking(rows: DataFrame, column: str, top: int = 10, lower: bool = True) -> DataFrame:
    """The most frequent parts of a multi-valued column."""
    c = F.lower(column) if lower else F.col(column)
    parts = rows.select(F.explode(F.transform(F.split(c, ";"), lambda x: F.trim(x))).alias("v")).where("v <> ''")
    return ranking(parts, "v", top)


def category_rollup(rows: DataFrame, column: str, groups: dict) -> DataFrame:
    """(category, n): values counted in every category that holds them."""
    table = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(k).alias("category")) for k, vs in groups.items() for v in vs))
    small = F.broadcast(rows.sparkSession.range(1).select(F.inline(table)))  # a row a constant
    counted = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    return counted.join(small, "v").groupBy("category").agg(F.sum("k").alias("n"))


def index_quantiles(rows: DataFrame, value: str, shares=(0.1, 0.5, 0.9)) -> DataFrame:
    """One row: for each share q the value at index floor(n * q) of the ascending order, with mean, minimum and maximum.

    Equal values are counted, so the running order is over different values only.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("k").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = per.select("v", "k", upto.alias("upto"), n.alias("n"))
    names = [f"p{round(q * 100)}" for q in shares]
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(q)), F.col("v"))).alias(k) for q, k in zip(shares, names, strict=True)]
    return at.agg(*picks, (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.sum("k").alias("n"))
