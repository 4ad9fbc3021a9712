"""OpenStreetMap XML as a map.

``read`` parses files once, in as many tasks as they have splits (``osm_split``),
and keeps the elements as Parquet in the shared folder, from which queries prune
and push down. ``read_whole`` goes through Spark's XML reader, one lazy scan for
each sort of element and one task a file; it gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import GeoMap
from ..session import scratch
from . import osm_split

_TAG = "tag array<struct<_k: string, _v: string>>"
_SCHEMAS = {
    "node": f"_id string, _lat string, _lon string, {_TAG}",
    "way": f"_id string, nd array<struct<_ref: string>>, {_TAG}",
    "relation": f"_id string, member array<struct<_type: string, _ref: string, _role: string>>, {_TAG}",
}


def tags_map(tag: Column) -> Column:
    """A tag map: empty keys and values are dropped, of a repeated key the last value stays."""
    kept = F.filter(F.coalesce(tag, F.array().cast("array<struct<_k: string, _v: string>>")), lambda x: (x["_k"] != "") & (x["_v"] != ""))
    last = F.filter(F.transform(kept, lambda x, i: F.struct(x["_k"].alias("key"), x["_v"].alias("value"), i.alias("i"))), lambda x: ~F.exists(F.slice(kept, x["i"] + 2, F.size(kept)), lambda y: y["_k"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def _scan(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("nullValue", "\u0000").schema(_SCHEMAS[tag]).load(paths)
    return rows.where("_id is not null").withColumn("ord", F.monotonically_increasing_id()).withColumn("tags", tags_map(F.col("tag")))


def _map(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None) -> GeoMap:
    """Nodes whose coordinates are no numbers, ways without tags or references, relations without tags or members are left out."""
    nodes = nodes.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")}).where("lat is not null and lon is not null")
    coords = nodes.groupBy("id").agg(F.max_by(F.struct("lat", "lon"), "ord").alias("p")).select("id", "p.lat", "p.lon")
    ways = ways.where((F.size("tags") > 0) & (F.size("node_refs") > 0))
    found = relations.where((F.size("tags") > 0) & (F.size("members") > 0)) if relations is not None else None
    return GeoMap(nodes.where(F.size("tags") > 0), coords, ways, found)


def read(spark: SparkSession, paths: str | list[str], relations: bool = True, target: str | None = None) -> GeoMap:
    """The map of one or more files: tagged nodes, all coordinates, ways with tags and references, relations with tags and members.

    Files are parsed here and now, once, into ``target`` or a new folder below
    the shared one; what the map's tables read is that.
    """
    rows = osm_split.ingest(spark, paths, target or scratch(spark, "osm"))
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select("id", *cols, "tags", "ord")
    return _map(of("node", "lat", "lon").select("id", "lat", "lon", "tags", "ord"), of("way", "node_refs"), of("relation", "members") if relations else None)


def read_whole(spark: SparkSession, paths: str | list[str], relations: bool = True) -> GeoMap:
    """``read`` through Spark's XML reader: nothing is stored, a file is one task, each table is a scan."""
    nodes = _scan(spark, paths, "node").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "tags", "ord")
    ways = _scan(spark, paths, "way").select(F.col("_id").alias("id"), F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref: string>>")), lambda x: x["_ref"]).alias("node_refs"), "tags", "ord")
    found = None
    if relations:
        members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type: string, _ref: string, _role: string>>")), lambda x: F.struct(x["_type"].alias("type"), x["_ref"].alias("ref"), F.coalesce(x["_role"], F.lit("")).alias("role")))
        found = _scan(spark, paths, "relation").select(F.col("_id").alias("id"), members.alias("members"), "tags", "ord")
    return _map(nodes, ways, found)


def to_parquet(m: GeoMap, path: str) -> None:
    """Store a map as Parquet tables, sorted by place and id for pruning."""
    m.nodes.sort("lat").write.mode("overwrite").parquet(f"{path}/nodes")
    m.coords.write.mode("overwrite").parquet(f"{path}/coords")
    m.ways.write.mode("overwrite").parquet(f"{path}/ways")
    if m.relations is not None:
        m.relations.write.mode("overwrite").parquet(f"{path}/relations")


def from_parquet(spark: SparkSession, path: str, relations: bool = True) -> GeoMap:
    at = lambda t: spark.read.parquet(f"{path}/{t}")
    return GeoMap(at("nodes"), at("coords"), at("ways"), at("relations") if relations else None)


def markup_values(text: Column, tag: str, attribute: str) -> Column:
    """All values of an attribute of a tag in raw markup, entities left as they are."""
    return F.regexp_extract_all(text, F.lit(f'<{tag}\\b[^>]*\\b{attribute}="([^"]+)"'), F.lit(1))
