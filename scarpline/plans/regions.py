"""Queries of study areas, assets along ways and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions import geodesy as D
from scarpline.functions.geodesy import equirect_km
from scarpline.functions.texts import clean_name, poi_kind, road_kind
from scarpline.operators import catalog as K
from scarpline.operators import exposure as X
from scarpline.operators import registry as A
from scarpline.operators.pipelines import propagate_exposure
from scarpline.plans import views as V
from scarpline.plans.terrain import utm_sql


def study_area_list(s, d):
    return A.list_areas(V.table(s, d, "study_areas"))


def study_area_sources(s, d):
    a = V.table(s, d, "study_areas")
    p = A.area_paths(F.concat(F.lit("data/study_areas/"), F.col("name")))
    return a.select("name", A.pbf_path(F.col("osm_pbf_path")).alias("pbf"), p["dem"].alias("dem"), F.coalesce("local_relief_fallback_m", F.lit(500.0)).alias("relief"))


def study_area_locate(s, d):
    return A.locate(V.lookups(s, d), V.table(s, d, "study_areas"), "lookup_id").select("lookup_id", "area")


def _uploads(s, d):
    return V.lookups(s, d).select("lookup_id", F.col("lat").alias("embedded_lat"), F.col("lon").alias("embedded_lon"), "region", (F.col("lat") + (F.col("lookup_id") % 4) * 0.004).alias("lat"), F.col("lon").alias("lon"))


def location_crosscheck(s, d):
    c = A.crosscheck(_uploads(s, d), V.table(s, d, "study_areas"), "lookup_id", equirect_km("embedded_lat", "embedded_lon", "lat", "lon"))
    return c.select("lookup_id", "embedded_area", F.coalesce("state", F.lit("?")).alias("state"))


def location_crosscheck_geodesic(s, d):
    c = A.crosscheck(_uploads(s, d), V.table(s, d, "study_areas"), "lookup_id")
    return c.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance_km"), 4).alias("mean_km"))


def input_bounds(s, d):
    a = V.table(s, d, "study_areas").select(F.col("name").alias("region"), "bbox")
    t = V.lookups(s, d).where("lat is not null and lon is not null").join(F.broadcast(a), "region")  # 60 areas, fixed
    return t.select("lookup_id", A.clamped_input(F.col("lat"), F.col("lon"), F.col("bbox")).alias("c")).select("lookup_id", "c.lat", "c.lon", "c.valid")


def asset_classify(s, d):
    a = V.asset_rows(s, d)
    return a.select("asset_id", F.when(F.col("highway").isNotNull(), road_kind("bridge")).otherwise(poi_kind("amenity", "place")).alias("kind"))


def asset_counts(s, d):
    a = V.asset_rows(s, d)
    return a.groupBy("area").agg(F.count("highway").alias("roads"), F.count_if(F.col("highway").isNotNull() & F.col("bridge").isNotNull()).alias("bridges"), F.count_if(poi_kind("amenity", "place") != "other").alias("pois"))


def clean_names(s, d):
    a = V.asset_rows(s, d).withColumn("geometry", F.lit(None).cast("string"))
    u = X.assets(a.where("highway is not null"), a.where("highway is null"))
    return u.select("asset_id", "area", "name", "asset_type")


def _ways(s, d):
    """Ways of six corners through the square of assets, one for each nation."""
    n = V.table(s, d, "nation").select(F.col("n_nationkey").alias("way"))
    p = n.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return p.select("way", "seq", (F.col("way") * 700.0 + F.col("seq") * 1500.0).alias("x"), (F.col("way") * 300.0 + F.col("seq") * 400.0 + (F.col("seq") % 2) * 900.0 - 1000.0).alias("y"))


def _spots(s, d):
    c = V.table(s, d, "customer")
    kinds = F.create_map(*[F.lit(x) for x in ("BUILDING", "building", "MACHINERY", "bridge", "AUTOMOBILE", "road", "HOUSEHOLD", "settlement", "FURNITURE", "helipad")])
    x, y = ((F.col("c_custkey") * 7919) % 20000).cast("double"), F.col("c_acctbal").cast("double")
    return c.select(F.col("c_custkey").alias("asset_id"), clean_name(F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("spot "), (F.col("c_custkey") % 200).cast("string"))), kinds[F.col("c_mktsegment")]).alias("name"), kinds[F.col("c_mktsegment")].alias("asset_type"), x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"))


def line_reference(s, d):
    r = X.line_reference(X.segments(_ways(s, d), "way"), _spots(s, d), "way", "asset_id")
    return r.select("way", "asset_id", F.round("lateral_m", 3).alias("lateral_m"), F.round("along_m", 3).alias("along_m"))


def _exposed(s, d):
    spots = _spots(s, d)
    r = X.line_reference(X.segments(_ways(s, d), "way"), spots, "way", "asset_id")
    r = r.join(spots.select("asset_id", "name", "asset_type"), "asset_id")
    base = F.when(F.col("way") % 3 == 0, C.VERDICT_BASE["stable"]).when(F.col("way") % 3 == 1, C.VERDICT_BASE["uncertain"]).otherwise(C.VERDICT_BASE["breach_risk"])
    return X.exposure(r, "way", "asset_id", base)


def exposure_topk(s, d):
    return _exposed(s, d)


def asset_ranking(s, d):
    return X.rank_assets(_exposed(s, d), "way", "asset_id")


def exposure_chain(s, d):
    """Scars at nodes of the forest, one for each nation, down to ranked assets: customers as points with WKT, in metres of their zone."""
    nodes, edges = V.forest(s, d)
    at = V.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("way"))
    verdict = F.when(F.col("way") % 3 == 0, "stable").when(F.col("way") % 3 == 1, "uncertain").otherwise("breach_risk")
    scars = at.select("way", (F.col("way") * 37 + 7).alias("node"), verdict.alias("verdict"), F.lit("EPSG:32645").alias("utm_crs"))
    c = V.table(s, d, "customer")
    lat, lon = 27.5 + (F.col("c_custkey") % 1000) / 1000, 84.5 + (F.col("c_custkey") * 7919 % 1500) / 10000
    kinds = F.create_map(*[F.lit(x) for x in ("BUILDING", "building", "MACHINERY", "bridge", "AUTOMOBILE", "road", "HOUSEHOLD", "settlement", "FURNITURE", "helipad")])
    a = c.select(F.col("c_custkey").alias("asset_id"), F.concat(F.lit("spot "), (F.col("c_custkey") % 200).cast("string")).alias("name"), kinds[F.col("c_mktsegment")].alias("asset_type"), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")).alias("geometry"))
    p = X.pieces(a, "asset_id", F.lit("EPSG:32645"))
    r = propagate_exposure(scars, nodes, edges, p, a, "way", "node", radius_km=0.2)
    return r.select("way", "asset_id", "name", "type", "distance_km", "lateral_offset_km", "exposure_score", "weight", "risk_score", "rank")


def asset_points(s, d):
    """A point for each asset's geometry, told by the area's box that holds it."""
    a = V.table(s, d, "exposure").groupBy("asset_id").agg(F.min("geometry").alias("geometry"))
    return X.representative_points(a, "asset_id").select("asset_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def asset_clip(s, d):
    a = V.table(s, d, "exposure").groupBy("asset_id").agg(F.min("area").alias("area"), F.min("geometry").alias("geometry"))
    return X.clipped(a, V.table(s, d, "study_areas"), "asset_id").select("asset_id", "area")


def path_cumulative(s, d):
    return X.segments(_ways(s, d), "way").select("way", "seq", F.round("start_m", 6).alias("start_m"), F.round("length_m", 6).alias("length_m"))


def least_cloudy(s, d):
    scenes = V.table(s, d, "events").select(F.col("event_id").alias("scene_id"), "ts", F.col("value").alias("cloud"), F.col("user_id").alias("site"))
    wanted = s.sql("select * from values ('before', date'2024-01-08', 3), ('after', date'2024-01-20', 5) as t(stage, target, window_days)")
    sites = scenes.select("site").distinct().crossJoin(F.broadcast(wanted)).withColumnRenamed("site", "for_site")  # wanted has two rows
    return K.least_cloudy(scenes, sites, ["for_site", "stage"], F.col("site") == F.col("for_site"))


def case_stages(s, d):
    a = V.table(s, d, "study_areas").select(F.col("name").alias("case"), F.expr("map('before', named_struct('target', date'2014-07-01', 'window_days', 30), 'after', named_struct('target', date'2014-08-02', 'window_days', length(name)))").alias("stages"))
    return K.stages(a).select("case", "stage", "target", F.date_sub("target", F.col("window_days")).alias("begins"))


def best_so_far(s, d):
    e = V.table(s, d, "events").select("user_id", "event_id", F.col("value").alias("metric"))
    return K.best_so_far(e, "user_id", "event_id", "metric").select("user_id", "event_id", "best", "since")


def best_epoch(s, d):
    e = V.table(s, d, "events").select("user_id", "event_id", F.col("value").alias("metric"))
    return K.best_epoch(e, "user_id", "event_id", "metric")


def largest_per_bucket(s, d):
    return K.largest_per_bucket(V.table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("area")), "l_suppkey", "l_partkey", "area")


def config_agreement(s, d):
    return K.config_agreement(V.table(s, d, "dataset_config"), ["sensor"])


def model_configs(s, d):
    c = V.table(s, d, "dataset_config").select("dataset", "gsd_m_per_px", "georeferenced")
    t = c.where("gsd_m_per_px is not null").select(F.concat(F.lit("gsd-"), F.col("gsd_m_per_px").cast("string")).alias("model"), "dataset")
    m = K.model_configs(c, t.unionByName(s.sql("select 'gsd-none' as model, 'no such dataset' as dataset")))
    every = t.select("model").distinct().unionByName(s.sql("select 'gsd-none' as model")).join(m, "model", "left")
    return K.gsd_of(every).select("model", "gsd_m_per_px")


_NAMES = (
    "study_area_list study_area_sources study_area_locate location_crosscheck location_crosscheck_geodesic input_bounds asset_classify asset_counts clean_names line_reference exposure_topk "
    "asset_ranking exposure_chain asset_points asset_clip path_cumulative least_cloudy case_stages best_so_far best_epoch largest_per_bucket config_agreement model_configs"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LOCATED = f"{V.LOOKUPS}, located AS (SELECT l.*, (SELECT min(name) FROM study_areas a WHERE l.lon BETWEEN bbox[1] AND bbox[3] AND l.lat BETWEEN bbox[2] AND bbox[4]) AS area FROM lookups l)"
_KIND = "CASE WHEN amenity = 'school' THEN 'school' WHEN amenity IN ('hospital', 'clinic', 'health_post', 'doctors') THEN 'health' WHEN place IN ('city', 'town', 'village', 'hamlet') THEN 'settlement' ELSE 'other' END"
_WAYS = """corners AS (SELECT n_nationkey AS way, seq, n_nationkey * 700.0::DOUBLE + seq * 1500.0::DOUBLE AS x, n_nationkey * 300.0::DOUBLE + seq * 400.0::DOUBLE + (seq % 2) * 900.0::DOUBLE - 1000.0::DOUBLE AS y FROM nation, range(0, 6) r(seq)),
pieces AS (SELECT way, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM corners WINDOW w AS (PARTITION BY way ORDER BY seq)),
segs AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY way ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_m FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length_m FROM pieces WHERE x1 IS NOT NULL))"""
_SPOTS = """spots AS (SELECT *, CASE WHEN asset_id % 7 <> 0 THEN 'spot ' || (asset_id % 200) ELSE 'unnamed ' || asset_type END AS name FROM (SELECT c_custkey AS asset_id, ((c_custkey * 7919) % 20000)::DOUBLE AS px, c_acctbal::DOUBLE AS py,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'bridge' WHEN 'AUTOMOBILE' THEN 'road' WHEN 'HOUSEHOLD' THEN 'settlement' WHEN 'FURNITURE' THEN 'helipad' END AS asset_type FROM customer))"""
_REF = f"""{_WAYS}, {_SPOTS},
shadow AS (SELECT way, asset_id, name, asset_type, px, py, x0, y0, x1, y1, start_m, length_m, least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (length_m * length_m), 0.0), 1.0) AS t FROM segs, spots),
beside AS (SELECT way, asset_id, name, asset_type, round(sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0))), 6) AS lateral_m, start_m + t * length_m AS along_m FROM shadow),
ref AS (SELECT way, asset_id, name, asset_type, min(lateral_m) AS lateral_m, arg_min(along_m, (lateral_m, along_m)) AS along_m FROM beside WHERE lateral_m <= 1000 GROUP BY ALL)"""
_EXPOSED = f"""{_REF},
once AS (SELECT * FROM ref QUALIFY row_number() OVER (PARTITION BY way, name, asset_type, round(along_m / 1000, 2) ORDER BY along_m / 1000, lateral_m, asset_id) = 1),
exposed AS (SELECT way, asset_id, name, asset_type AS type, round(along_m / 1000, 3) AS distance_km, round(lateral_m / 1000, 3) AS lateral_offset_km, round(CASE way % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END * exp(-(along_m / 1000) / 8.0::DOUBLE), 4) AS exposure_score FROM once),
top AS (SELECT * FROM exposed QUALIFY row_number() OVER (PARTITION BY way ORDER BY distance_km, name, asset_id) <= 50)"""
_CHAIN = f"""{V.FOREST},
way(way, seq, node, dist) AS (SELECT n_nationkey, 0, n_nationkey * 37 + 7, 0.0::DOUBLE FROM nation JOIN nodes ON node = n_nationkey * 37 + 7 UNION ALL SELECT w.way, w.seq + 1, e.dst, w.dist + e.dist FROM way w JOIN edges e ON e.src = w.node),
here AS (SELECT w.*, n.lat, n.lon, lag(dist) OVER k AS d0, lag(n.lat) OVER k AS lat0, lag(n.lon) OVER k AS lon0 FROM way w JOIN nodes n USING (node) WINDOW k AS (PARTITION BY way ORDER BY seq)),
clip AS (SELECT way, seq, 'EPSG:32645' AS crs, CASE WHEN dist <= 200 THEN lat ELSE lat0 + (200 - d0) / (dist - d0) * (lat - lat0) END AS lat, CASE WHEN dist <= 200 THEN lon ELSE lon0 + (200 - d0) / (dist - d0) * (lon - lon0) END AS lon FROM here WHERE d0 IS NULL OR d0 < 200),
{utm_sql("clip", "corners")},
pieces AS (SELECT way, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM corners WINDOW w AS (PARTITION BY way ORDER BY seq)),
segs AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY way ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_m FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length_m FROM pieces WHERE x1 IS NOT NULL)),
site AS (SELECT c_custkey AS asset_id, 'EPSG:32645' AS crs, 27.5 + (c_custkey % 1000) / 1000 AS lat, 84.5 + (c_custkey * 7919 % 1500) / 10000 AS lon, 'spot ' || (c_custkey % 200) AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'bridge' WHEN 'AUTOMOBILE' THEN 'road' WHEN 'HOUSEHOLD' THEN 'settlement' WHEN 'FURNITURE' THEN 'helipad' END AS asset_type FROM customer),
{utm_sql("site", "placed")}, spots AS (SELECT asset_id, name, asset_type, x AS px, y AS py FROM placed)"""
_RANKED = """weighed AS (SELECT *, CASE type WHEN 'bridge' THEN 0.95::DOUBLE WHEN 'settlement' THEN 0.8::DOUBLE WHEN 'road' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM top),
scored AS (SELECT *, round((exposure_score * weight)::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS risk_score FROM weighed) SELECT *, row_number() OVER (PARTITION BY way ORDER BY risk_score DESC, distance_km, name, asset_id)::INT AS rank FROM scored"""
SQL = {
    "exposure_chain": f"WITH RECURSIVE {_EXPOSED.replace(_WAYS, _CHAIN).replace(f', {_SPOTS}', '')}, {_RANKED}",
    "study_area_list": "SELECT name FROM study_areas ORDER BY name",
    "study_area_sources": "SELECT name, coalesce(nullif(osm_pbf_path, ''), 'data/raw/osm/extract.osm.pbf') AS pbf, 'data/study_areas/' || name || '/dem_glo30.tif' AS dem, coalesce(local_relief_fallback_m, 500.0) AS relief FROM study_areas",
    "study_area_locate": f"WITH {_LOCATED} SELECT lookup_id, area FROM located",
    "location_crosscheck": f"""WITH {_LOCATED} SELECT lookup_id, area AS embedded_area, coalesce(CASE WHEN lat IS NULL OR lon IS NULL THEN 'none' WHEN area IS NULL THEN 'outside' WHEN area <> region THEN 'region_mismatch' WHEN abs(lat + (lookup_id % 4) * 0.004::DOUBLE - lat) * 111.32::DOUBLE > 1 THEN 'point_mismatch' ELSE 'confirmed' END, '?') AS state
FROM located""",
    "input_bounds": f"WITH {V.LOOKUPS} SELECT lookup_id, round(lat::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS lat, round(lon::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS lon, lon BETWEEN bbox[1] AND bbox[3] AND lat BETWEEN bbox[2] AND bbox[4] AS valid FROM lookups JOIN study_areas ON name = region WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "asset_classify": f"WITH {V.ASSETS} SELECT asset_id, CASE WHEN highway IS NOT NULL THEN CASE WHEN bridge IS NOT NULL THEN 'bridge' ELSE 'road' END ELSE {_KIND} END AS kind FROM assets",
    "asset_counts": f"WITH {V.ASSETS} SELECT area, count(highway) AS roads, count(*) FILTER (WHERE highway IS NOT NULL AND bridge IS NOT NULL) AS bridges, count(*) FILTER (WHERE {_KIND} <> 'other') AS pois FROM assets GROUP BY area",
    "clean_names": f"""WITH {V.ASSETS} SELECT asset_id, area, coalesce(name, 'unnamed ' || highway) AS name, CASE WHEN bridge IS NOT NULL THEN 'bridge' ELSE 'road' END AS asset_type FROM assets WHERE highway IS NOT NULL
UNION ALL SELECT asset_id, area, coalesce(name, 'unnamed ' || {_KIND}) AS name, {_KIND} AS asset_type FROM assets WHERE highway IS NULL AND {_KIND} <> 'other'""",
    "line_reference": f"WITH {_REF} SELECT way, asset_id, round(lateral_m, 3) AS lateral_m, round(along_m, 3) AS along_m FROM ref",
    "exposure_topk": f"WITH {_EXPOSED} SELECT * FROM top",
    "asset_ranking": f"WITH {_EXPOSED}, {_RANKED}",
    "path_cumulative": f"WITH {_WAYS} SELECT way, seq::INT AS seq, round(start_m, 6) AS start_m, round(length_m, 6) AS length_m FROM segs",
    "least_cloudy": """WITH wanted(stage, target, w) AS (VALUES ('before', DATE '2024-01-08', 3), ('after', DATE '2024-01-20', 5))
SELECT user_id AS for_site, stage, arg_min(event_id, (value, ts, event_id)) AS scene_id, arg_min(ts, (value, ts, event_id)) AS ts, min(value) AS cloud FROM events, wanted WHERE ts >= target - w::INT AND ts < target + w::INT GROUP BY user_id, stage""",
    "case_stages": """SELECT name AS "case", 'before' AS stage, DATE '2014-07-01' AS target, DATE '2014-06-01' AS begins FROM study_areas UNION ALL SELECT name, 'after', DATE '2014-08-02', DATE '2014-08-02' - length(name)::INT FROM study_areas""",
    "best_so_far": """WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events)
SELECT user_id, event_id, best, event_id - min(event_id) OVER (PARTITION BY user_id, best) AS since FROM b""",
    "best_epoch": "SELECT user_id, arg_min(event_id, (-value, event_id)) AS best_epoch, max(value) AS best, max(event_id) AS epochs FROM events GROUP BY user_id",
    "largest_per_bucket": "WITH a AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS area FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_min(l_partkey, (-area, l_partkey)) AS l_partkey, max(area) AS area FROM a GROUP BY l_suppkey",
    "config_agreement": "SELECT sensor, count(DISTINCT gsd_m_per_px) AS n_gsd, CASE count(DISTINCT gsd_m_per_px) WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN min(gsd_m_per_px) END AS gsd_m_per_px, count(DISTINCT gsd_m_per_px) <= 1 AS agree FROM dataset_config GROUP BY sensor",
    "model_configs": "SELECT DISTINCT 'gsd-' || gsd_m_per_px AS model, gsd_m_per_px FROM dataset_config WHERE gsd_m_per_px IS NOT NULL UNION ALL SELECT 'gsd-none', 10.0",
}
