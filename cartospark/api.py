"""The library's front: open a map, filter it, extract, export, merge."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import aggregates, ordering
from .plans import features
from .plans.filters import MapFilter
from .plans.model import GeoMap, is_closed
from .sources import osm_xml, sinks


class Cartographer:
    """``Cartographer(spark, filter).extract_features(path)`` and friends; results are DataFrames until they are exported."""

    def __init__(self, spark: SparkSession, map_filter: MapFilter | None = None) -> None:
        self.spark, self.filter = spark, map_filter
        self.stats: dict[str, float] = {"exports": 0, "seconds": 0.0, "records": 0}

    def open(self, path: str | list[str]) -> GeoMap:
        m = osm_xml.read(self.spark, path)
        return self.filter.apply(m) if self.filter and self.filter.active() else m

    def extract_features(self, path: str | list[str]) -> dict[str, DataFrame]:
        m = self.open(path)
        return {k: features.extract(m, s) for k, s in (("amenities", "amenities"), ("highways", "highways"), ("buildings", "building_shapes"))}

    def amenities_by_category(self, path: str, target: str) -> None:
        """One folder per amenity group."""
        sinks.tiles(features.extract(self.open(path), "amenities").withColumn("tile", F.col("category")), target)

    def amenities_by_type(self, path: str, target: str, types: list[str] | None = None) -> DataFrame:
        """One folder per amenity type (all there are, or some) of GeoJSON features, in one pass; (type, points, lines, polygons) of what each holds."""
        m, t = self.open(path), F.col("tags")
        wanted = t["amenity"].isin(types) if types else F.map_contains_key("tags", F.lit("amenity"))
        nodes = m.nodes.where(wanted).select(t["amenity"].alias("tile"), F.lit("points").alias("shape"), sinks.feature_json(sinks.point_json(F.col("lon"), F.col("lat")), t, F.col("id")).alias("feature"))
        ways = m.with_(ways=m.ways.where(wanted)).way_geometry().where(F.size("coords") >= 2)
        shape = F.when(is_closed(F.col("node_refs")), "polygons").otherwise("lines")
        rows = nodes.unionByName(ways.select(t["amenity"].alias("tile"), shape.alias("shape"), sinks.feature_json(sinks.line_json(F.col("coords")), t, F.col("id")).alias("feature")))
        rows.select("tile", "feature").write.mode("overwrite").partitionBy("tile").text(target)
        return rows.groupBy(F.col("tile").alias("type")).agg(*(F.count_if(F.col("shape") == k).alias(k) for k in ("points", "lines", "polygons"))).orderBy("type")

    def _timed(self, write) -> int:
        began = time.time()
        n = write()
        self.stats["exports"] += 1
        self.stats["seconds"] += time.time() - began
        self.stats["records"] += n or 0
        return n

    def extract_to_geojson(self, path, target: str) -> int:
        return self._timed(lambda: sinks.geojson(sinks.features(self.open(path)), target))

    def extract_to_json(self, path, target: str) -> int:
        found = self.extract_features(path)
        rows = None
        for k, d in found.items():
            d = d.select(F.lit(k).alias("layer"), "elem", "id", "kind", "category", "name", "lon", "lat")
            rows = d if rows is None else rows.unionByName(d)
        return self._timed(lambda: sinks.json_rows(rows, target))

    def extract_to_csv(self, path, target: str) -> None:
        self._timed(lambda: sinks.csv(sinks.wide(self.open(path), area=True, length=True), target))

    def extract_to_xml(self, path, target: str) -> int:
        return self._timed(lambda: sinks.osm_xml(self.open(path), target))

    def convert(self, path, target: str, form: str | None = None, nodes_only: bool = False, ways_only: bool = False, area: bool = True, length: bool = True, flatten_tags: bool = True) -> int | None:
        """To ``form``, or by the target's extension; the number of records where it is a single document.

        Nodes alone or ways alone, if wanted; elements without tags are left out
        by the scan. CSV has a column per tag key, or all tags as one JSON text,
        and areas and lengths of ways if wanted. JSON is compact.
        """
        m = self.open(path)
        if nodes_only:
            m = m.with_(ways=m.ways.where("false"), relations=None)
        if ways_only:
            m = m.with_(nodes=m.nodes.where("false"), relations=None)
        form = form or sinks.format_of(target)
        if form == "csv":
            return self._timed(lambda: sinks.csv(sinks.wide(m, area=area, length=length, flatten=flatten_tags), target))
        if form == "geojson":
            return self._timed(lambda: sinks.geojson(sinks.features(m), target))
        if form == "json":
            return self._timed(lambda: sinks.json_rows(sinks.wide(m, area=area, length=length, flatten=False), target))
        if form == "osm":
            return self._timed(lambda: sinks.osm_xml(m, target))
        raise ValueError(f"no writer for {form!r}")

    def merge(self, paths: list[str], target: str | None = None) -> GeoMap:
        """Maps of several files; of equal ids the last file's element stays."""
        if len(paths) < 2:
            raise ValueError("two files or more are needed")
        maps = [self.open(p) for p in paths]
        both = lambda parts: ordering.merge(parts)
        m = GeoMap(both([x.nodes for x in maps]), both([x.coords.withColumn("ord", F.lit(0)) for x in maps]).drop("ord"), both([x.ways for x in maps]), both([x.relations for x in maps]))
        if target:
            sinks.osm_xml(m, target)
        return m

    def info(self, path) -> DataFrame:
        return aggregates.info(self.open(path))

    def get_processing_stats(self) -> dict[str, float]:
        s = dict(self.stats)
        return s | {"records_per_second": s["records"] / s["seconds"] if s["seconds"] else 0.0}

    #: Speeds assumed where a road has no limit.
    default_speeds = C.EXTRACT_SPEEDS
