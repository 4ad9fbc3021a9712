"""The star schema seen as a map, so that every operator has rows on both engines.

Parts are nodes, orders are ways, line items their references, nations the
members of region relations, customers and suppliers further points. Places and
tags are arithmetic on keys. ``star`` builds the map with Spark; ``CTES`` is the
same as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .plans.model import GeoMap

#: Tags dealt to nodes and ways: one or two pairs each, by key modulo the length.
POOL: tuple[tuple[str, str], ...] = (
    ("amenity", "restaurant"), ("shop", "bakery"), ("amenity", "bank"), ("tourism", "hotel"), ("leisure", "park"), ("natural", "peak"), ("amenity", "school"), ("shop", "supermarket"), ("amenity", "pharmacy"), ("healthcare", "doctor"),
    ("railway", "station"), ("highway", "bus_stop"), ("public_transport", "platform"), ("amenity", "parking"), ("historic", "castle"), ("heritage", "2"), ("emergency", "fire_hydrant"), ("barrier", "gate"), ("power", "tower"), ("natural", "tree"),
    ("highway", "crossing"), ("crossing", "traffic_signals"), ("traffic_calming", "hump"), ("man_made", "surveillance"), ("amenity", "bicycle_parking"), ("shop", "bicycle"), ("sport", "soccer"), ("leisure", "pitch"), ("addr:street", "High Street"), ("addr:housenumber", "12"),
    ("building", "house"), ("building", "church"), ("landuse", "forest"), ("landuse", "retail"), ("natural", "wood"), ("waterway", "river"), ("water", "lake"), ("railway", "rail"), ("boundary", "administrative"), ("admin_level", "8"),
    ("amenity", "cafe"), ("cuisine", "pizza; Italian"), ("amenity", "hospital"), ("office", "lawyer"), ("place", "town"), ("amenity", "bench"), ("lit", "yes"), ("highway", "traffic_signals"), ("barrier", "fence"), ("bridge", "viaduct"),
    ("amenity", "place_of_worship"), ("tourism", "museum"), ("wikidata", "Q1"), ("capacity", "25"), ("natural", "tree_row"), ("historic", "memorial"), ("emergency", "phone"), ("cycleway", "lane"), ("bicycle", "designated"), ("highway", "cycleway"), ("sidewalk", "both"),
)
_ROADS = ("motorway", "primary", "secondary", "residential", "footway")
_SURFACES = ("asphalt", "gravel", "cobblestone", "mystery")
_SPEEDS = ("50", "30 mph", "none", "60 km/h", "100")
_LANES = ("1", "2", "3", "x")


def _pool(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("no"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(POOL)))
    return F.broadcast(spark.range(1).select(F.inline(rows)))  # len(POOL) rows


def _place(key: str) -> tuple:
    k = F.col(key)
    return (F.lit(51.0) + (k * 7919 % 10007) / F.lit(10007.0)).alias("lat"), (F.lit(-0.5) + (k * 104729 % 10009) / F.lit(10009.0)).alias("lon")


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """(id, lat, lon) of another table's rows."""
    lat, lon = _place(key)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("id"), lat, lon)


def star(spark: SparkSession, sf_dir: str) -> GeoMap:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pool, n = _pool(spark), len(POOL)
    one, two = (pool.select(F.col("no").alias(f"no{i}"), F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    key, lat_lon = F.col("p_partkey"), _place("p_partkey")
    part = t("part").join(one, key % n == F.col("no1")).join(two, (key * 7 + 3) % n == F.col("no2"))
    tags = F.map_from_arrays(
        F.concat(F.array(F.lit("name"), F.lit("brand"), F.lit("size")), F.when(F.col("k1") == F.col("k2"), F.array("k2")).otherwise(F.array("k1", "k2"))),
        F.concat(F.array("p_name", "p_brand", F.col("p_size").cast("string")), F.when(F.col("k1") == F.col("k2"), F.array("v2")).otherwise(F.array("v1", "v2"))),
    )
    nodes = part.select(key.alias("id"), *lat_lon, tags.alias("tags"), key.alias("ord"))
    coords = t("part").select(key.alias("id"), *lat_lon)
    item = t("lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("ref"), "l_linenumber", "l_suppkey", "l_extendedprice")
    order = Window.partitionBy("way_id").orderBy("l_linenumber", "ref", "l_suppkey", "l_extendedprice")  # by the name that joins use, so that they need no other shuffle
    refs = item.select("way_id", (F.row_number().over(order) - 1).alias("pos"), "ref")
    o = F.col("o_orderkey")
    road = F.when(F.col("o_orderpriority") == "1-URGENT", _ROADS[0]).when(F.col("o_orderpriority") == "2-HIGH", _ROADS[1]).when(F.col("o_orderpriority") == "3-MEDIUM", _ROADS[2]).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", _ROADS[3]).otherwise(_ROADS[4])
    oneway = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "-1").otherwise("no")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (o % len(values) + 1).cast("int"))
    fixed = {"highway": road, "oneway": oneway, "name": F.col("o_orderpriority"), "surface": pick(_SURFACES), "maxspeed": pick(_SPEEDS), "lanes": pick(_LANES)}
    whole = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values())), lambda k, _: k != F.col("k1"))
    orders = t("orders").join(one, o % n == F.col("no1"))
    way_tags = F.map_concat(whole, F.create_map("k1", "v1"))
    packed = refs.groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("node_refs"))
    ways = orders.select(o.alias("id"), way_tags.alias("tags"), o.alias("ord")).join(packed.withColumnRenamed("way_id", "id"), "id").select("id", "node_refs", "tags", "ord")
    nation = t("nation").withColumn("role", F.when(F.col("n_nationkey") % 2 == 0, "outer").otherwise("inner"))
    members = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "role"))), lambda x: F.struct(F.lit("way").alias("type"), x["n_nationkey"].cast("long").alias("ref"), x["role"].alias("role"))).alias("members"))
    relations = t("region").join(members, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("long").alias("id"), "members", F.create_map(F.lit("type"), F.lit("multipolygon"), F.lit("name"), F.col("r_name")).alias("tags"), F.col("r_regionkey").cast("long").alias("ord"))
    return GeoMap(nodes, coords, ways, relations, refs)


def hav(a: str, b: str, c: str, d: str, radius: float) -> str:
    """SQL of the distance from (lon a, lat b) to (lon c, lat d)."""
    h = f"pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)"
    return f"(2 * {radius}e0 * asin(sqrt(least(1.0e0, {h}))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({c} - {a})) * cos(radians({d}))"
    x = f"cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c} - {a}))"
    return f"fmod(degrees(atan2({y}, {x})) + 720, 360)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def place(key: str) -> str:
    return f"51.0e0 + ({key} * 7919 % 10007) / 10007.0e0 AS lat, -0.5e0 + ({key} * 104729 % 10009) / 10009.0e0 AS lon"


_N = len(POOL)
_pick = lambda values: f"({_list(values)})[1 + o_orderkey % {len(values)}]"
_fixed = f"""map_from_entries(list_filter([{{'k': 'highway', 'v': CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'residential' ELSE 'footway' END}},
    {{'k': 'oneway', 'v': CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'P' THEN '-1' ELSE 'no' END}}, {{'k': 'name', 'v': o_orderpriority}}, {{'k': 'surface', 'v': {_pick(_SURFACES)}}},
    {{'k': 'maxspeed', 'v': {_pick(_SPEEDS)}}}, {{'k': 'lanes', 'v': {_pick(_LANES)}}}, {{'k': p1.k, 'v': p1.v}}], lambda e, i: e.k <> p1.k OR i = 7))"""

CTES: dict[str, str] = {
    "pool": "pool(no, k, v) AS (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(POOL)) + ")",
    "node": f"""node AS (SELECT p_partkey AS id, {place('p_partkey')}, map_from_entries(list_filter([{{'k': 'name', 'v': p_name}}, {{'k': 'brand', 'v': p_brand}}, {{'k': 'size', 'v': CAST(p_size AS VARCHAR)}}, {{'k': p1.k, 'v': p1.v}}, {{'k': p2.k, 'v': p2.v}}], lambda e, i: i <> 4 OR p1.k <> p2.k)) AS tags
    FROM part JOIN pool p1 ON p1.no = p_partkey % {_N} JOIN pool p2 ON p2.no = (p_partkey * 7 + 3) % {_N})""",
    "coord": f"coord AS (SELECT p_partkey AS id, {place('p_partkey')} FROM part)",
    "refs": "refs AS (SELECT l_orderkey AS way_id, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem)",
    "way": f"way AS (SELECT o_orderkey AS id, {_fixed} AS tags FROM orders JOIN pool p1 ON p1.no = o_orderkey % {_N} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))",
    "pts": "pts AS (SELECT way_id, pos, ref, lat, lon FROM refs JOIN coord ON id = ref)",
    "seg": "seg AS (SELECT * FROM (SELECT way_id, pos, ref AS src, lon AS lon1, lat AS lat1, lead(ref) OVER w AS dst, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM pts WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE dst IS NOT NULL)",
    "ring": "ring AS (SELECT way_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM pts WINDOW w AS (PARTITION BY way_id ORDER BY pos))",
    "shape": "shape AS (SELECT way_id, count(*) AS n, avg(x1) AS lon, avg(y1) AS lat, sum(x1 * y2 - x2 * y1) / 2 AS s FROM ring GROUP BY way_id)",
}
_NEEDS = {"node": ("pool",), "way": ("pool",), "pts": ("refs", "coord"), "seg": ("pts",), "ring": ("pts",), "shape": ("ring",)}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH clause of some of the tables, with what they need."""
    out: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS.get(n, ()):
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(CTES[n] for n in out)
