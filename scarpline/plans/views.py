"""Inputs of the queries that the tables don't hold as such, derived alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scars(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scars: price as area, quantity as upstream area, part size as relief."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    j = li.select(*keys, "l_extendedprice", "l_quantity").join(p.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(*keys, F.col("l_extendedprice").alias("area_m2"), (F.col("l_quantity") * 0.5).alias("upstream_area_km2"), (F.col("p_size") * 10.0).alias("local_relief_m"))


SCARS = """scars AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS area_m2, l_quantity * 0.5 AS q, p_size * 10.0 AS relief
  FROM lineitem JOIN part ON p_partkey = l_partkey),
volumes AS (SELECT *, 0.146 * pow(area_m2, 1.332) AS volume FROM scars),
heights AS (SELECT *, least(pow(volume, 1.0 / 3), relief) AS height FROM volumes),
assessed AS (SELECT *, log10(q * height / (volume / 1e6)) AS dbi FROM heights),
judged AS (SELECT *, CASE WHEN dbi < 2.75 THEN 'stable' WHEN dbi <= 3.08 THEN 'uncertain' ELSE 'breach_risk' END AS verdict FROM assessed)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 chips: green from a vector, near infrared from the next."""
    e = table(spark, sf, "embeddings")
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    a = e.crossJoin(F.broadcast(n)).select("vec_id", "embedding", ((F.col("vec_id") + 1) % F.col("n")).alias("next"))  # n is one row
    b = e.select(F.col("vec_id").alias("next"), F.col("embedding").alias("other"))
    z = F.zip_with("embedding", "other", lambda g, i: F.struct((1 + g.cast("double")).alias("green"), (1 + i.cast("double")).alias("nir")))
    return a.join(b, "next").select(F.col("vec_id").alias("chip_id"), F.posexplode(z).alias("pos", "v")).select("chip_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), "v.green", "v.nir")


PIXELS = """pixels AS (SELECT a.vec_id AS chip_id, ((p - 1) // 8)::INT AS row, ((p - 1) % 8)::INT AS col, 1 + a.embedding[p]::DOUBLE AS green, 1 + b.embedding[p]::DOUBLE AS nir
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings), range(1, 65) r(p)),
indexed AS (SELECT *, CASE WHEN green + nir = 0 THEN 0.0 ELSE (green - nir) / (green + nir) END AS ndwi FROM pixels)"""


def forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a drainage forest: (nodes, edges), each node flowing to half its number."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"))
    nodes = o.select("node", (27.5 + (F.col("node") % 1000) / 1000).alias("lat"), (84.5 + F.floor(F.col("node") / 1000) / 100).alias("lon"))
    edges = o.where("node > 0").select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst"), (30.0 + F.col("node") % 40).alias("dist"))
    return nodes, edges


FOREST = """nodes AS (SELECT o_orderkey AS node, 27.5 + (o_orderkey % 1000) / 1000 AS lat, 84.5 + (o_orderkey // 1000) / 100 AS lon FROM orders),
edges AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst, 30.0::DOUBLE + o_orderkey % 40 AS dist FROM orders WHERE o_orderkey > 0)"""


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as an elevation grid 40 cells wide: a slope with a little noise."""
    p = table(spark, sf, "part")
    return p.select(F.lit("a").alias("area"), F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.expr("1.5D * floor(p_partkey / 40) + 0.5D * (p_partkey % 40) + 0.05D * p_size").alias("elev"))


DEM = """dem AS (SELECT 'a' AS area, (p_partkey // 40)::INT AS row, (p_partkey % 40)::INT AS col, 1.5::DOUBLE * (p_partkey // 40) + 0.5::DOUBLE * (p_partkey % 40) + 0.05::DOUBLE * p_size AS elev FROM part)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset items, each once."""
    r = table(spark, sf, "rebuild_nepal_split")
    return r.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("dataset", "old_split", "img_path", "mask_path", "source_scene", "phash")])


ITEMS = "items AS (SELECT item_id, min(dataset) AS dataset, min(old_split) AS old_split, min(img_path) AS img_path, min(mask_path) AS mask_path, min(source_scene) AS source_scene, min(phash) AS phash FROM rebuild_nepal_split GROUP BY item_id)"


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Terrain lookups, each once."""
    t = table(spark, sf, "lookup")
    return t.groupBy("lookup_id").agg(*[F.min(c).alias(c) for c in ("region", "lat", "lon", "upstream_area_km2", "local_relief_m", "local_relief_is_real", "graph_node_id", "distance_to_channel_km")])


LOOKUPS = "lookups AS (SELECT lookup_id, min(region) AS region, min(lat) AS lat, min(lon) AS lon, min(upstream_area_km2) AS upstream_area_km2, min(local_relief_m) AS local_relief_m, min(distance_to_channel_km) AS distance_to_channel_km FROM lookup GROUP BY lookup_id)"


def asset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Assets, each once."""
    return table(spark, sf, "exposure").groupBy("asset_id").agg(*[F.min(c).alias(c) for c in ("area", "name", "asset_type", "highway", "bridge", "amenity", "place")])


ASSETS = "assets AS (SELECT asset_id, min(area) AS area, min(name) AS name, min(highway) AS highway, min(bridge) AS bridge, min(amenity) AS amenity, min(place) AS place FROM exposure GROUP BY asset_id)"


def slope(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as an elevation grid without pits and flats: the noise is less than a step down."""
    p = table(spark, sf, "part")
    return p.select(F.lit("a").alias("area"), F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.expr("1.5D * floor(p_partkey / 40) + 0.5D * (p_partkey % 40) + 0.005D * p_size").alias("elev"))


SLOPE = DEM.replace("0.05::DOUBLE", "0.005::DOUBLE")
