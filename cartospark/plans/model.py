"""The map model: nodes, coordinates, ways and relations as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AREA_KEYS


@dataclass(frozen=True)
class GeoMap:
    """nodes(id, lat, lon, tags, ord): tagged nodes. coords(id, lat, lon): all nodes. ways(id, node_refs, tags, ord).
    relations(id, members, tags, ord) or None. refs(way_id, pos, ref), pos from 0, if it is already there in long form.

    ``ord`` is the order of the source; "first" and "last" mean it.
    """

    nodes: DataFrame
    coords: DataFrame
    ways: DataFrame
    relations: DataFrame | None = None
    refs: DataFrame | None = None

    def way_refs(self) -> DataFrame:
        """(way_id, pos, ref) of every reference."""
        if self.refs is not None:
            return self.refs
        return self.ways.select(F.col("id").alias("way_id"), F.posexplode("node_refs").alias("pos", "ref"))

    def way_points(self, coord_scope: str = "all") -> DataFrame:
        """(way_id, pos, ref, lat, lon) of every reference that resolves; scope "tagged" resolves to tagged nodes only."""
        points = self.coords if coord_scope == "all" else self.nodes
        return self.way_refs().join(points.select(F.col("id").alias("ref"), "lat", "lon"), "ref").select("way_id", "pos", "ref", "lat", "lon")

    def lines(self, coord_scope: str = "all") -> DataFrame:
        """(way_id, coords): resolved coordinates in order, unresolved references left out."""
        packed = self.way_points(coord_scope).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
        return packed.select("way_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords"))

    def way_geometry(self, coord_scope: str = "all") -> DataFrame:
        """ways with coords; ways without any resolved reference are left out."""
        return self.ways.join(self.lines(coord_scope).withColumnRenamed("way_id", "id"), "id")

    def with_(self, **changes) -> GeoMap:
        return replace(self, **changes)


def is_closed(refs: Column) -> Column:
    """Four references or more, the last equal to the first."""
    return (F.size(refs) >= 4) & (F.element_at(refs, 1) == F.element_at(refs, -1))


def is_area(refs: Column, tags: Column) -> Column:
    return is_closed(refs) & F.exists(F.map_keys(tags), lambda k: k.isin(*AREA_KEYS))


def members_by_type(members: Column, kind: str) -> Column:
    return F.filter(members, lambda m: m["type"] == kind)


def members_by_role(members: Column, role: str) -> Column:
    return F.filter(members, lambda m: m["role"] == role)
