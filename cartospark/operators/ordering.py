"""Order, limits, samples and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.filters import simple, text_like
from ..plans.model import GeoMap


def all_elements(m: GeoMap) -> DataFrame:
    """(elem, id, tags, lat, lon, ord): nodes, then ways at their mean vertex; ways without one are left out."""
    from ..functions import geo

    lon, lat = geo.mean_point(F.col("coords"))
    ways = m.way_geometry().select(F.lit("way").alias("elem"), "id", "tags", lat.alias("lat"), lon.alias("lon"), "ord")
    return m.nodes.select(F.lit("node").alias("elem"), "id", "tags", "lat", "lon", "ord").unionByName(ways)


def sort(rows: DataFrame, by: str, numeric: bool = False, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows by id (as text), lat, lon, elem or a tag; equal keys keep their order, reversed or not.

    Tags compare in lower case, missing ones as empty; numeric keeps digits, "." and "-", what is no number comes lowest.
    """
    if by == "id":
        key = F.col("id").cast("string")
    elif by in ("lat", "lon", "elem"):
        key = F.col(by)
    else:
        key = F.coalesce(F.col("tags")[by], F.lit(""))
        key = F.coalesce(F.regexp_replace(key, r"[^0-9.\-]", "").try_cast("double"), F.lit(float("-inf"))) if numeric else F.lower(key)
    out = rows.orderBy(key.desc() if reverse else key.asc(), "elem", "ord")
    return out if limit is None else out.limit(limit)


def head(rows: DataFrame, n: int = 10, skip: int = 0, text: str | None = None) -> DataFrame:
    """Rows skip + 1 to skip + n in source order, nodes first."""
    rows = rows if text is None else rows.where(simple(text, F.col("tags"), lists=False))
    return rows.orderBy("elem", "ord").offset(skip).limit(n)


def search(rows: DataFrame, query: str, key: str | None = None, regex: bool = False, case: bool = False, limit: int = 0) -> DataFrame:
    """Rows of which one tag (or the given one) matches, in source order; limit 0: all."""
    t = F.col("tags")
    hit = text_like(t[key], query, regex, case) if key else F.exists(F.map_values(t), lambda v: text_like(v, query, regex, case))
    out = rows.where(hit)
    return out if limit <= 0 else out.orderBy("elem", "ord").limit(limit)


def sample(rows: DataFrame, n: int | None = None, percent: float | None = None, seed: int = 0, text: str | None = None, key: Column | None = None) -> DataFrame:
    """A uniform sample without replacement: the rows with the smallest hash of key and seed.

    The size is exact, a rerun takes the same rows, and any engine with md5 agrees.
    """
    rows = rows if text is None else rows.where(simple(text, F.col("tags")))
    key = key if key is not None else F.concat_ws(":", "elem", F.col("id").cast("string"))
    if n is None:
        n = int(rows.count() * (percent or 0) / 100)
    return rows.orderBy(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), key).limit(n)


def merge(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of tables with an ``ord`` column; of equal ids the row of the last table, and its last row, stays."""
    tagged = [p.withColumn("_file", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("ord")))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_file")


def overlap(a: Column, b: Column) -> Column:
    """Share of b's items that a has."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)
