"""Queries of scars, rasters and drainage."""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.functions import bands as B
from scarpline.functions import geodesy as D
from scarpline.functions import physics as P
from scarpline.functions import polygon as G
from scarpline.operators import hydrology as H
from scarpline.operators import raster as R
from scarpline.operators import scars as S
from scarpline.operators.detect import predict_floods, predict_slides
from scarpline.operators.graph import is_acyclic, walk
from scarpline.operators.pipelines import run_cases
from scarpline.plans import views as V

_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def scar_assessment(s, d):
    a = S.assess(V.scars(s, d))
    return a.select(*_KEYS, F.round("volume_m3", 6).alias("volume_m3"), F.round("dam_height_m", 6).alias("dam_height_m"), F.round("dbi", 6).alias("dbi"), "verdict")


def scar_verdict_counts(s, d):
    return S.assess(V.scars(s, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("scars"), F.round(F.avg("dbi"), 6).alias("mean_dbi"))


def relief_cap_effect(s, d):
    a = S.assess(V.scars(s, d)).withColumn("free", P.dam_height_m("volume_m3"))
    other = P.verdict(P.blockage_index("upstream_area_km2", "free", "volume_m3"))
    return a.agg(F.count_if(F.col("dam_height_m") < F.col("free")).alias("capped"), F.count_if(F.col("verdict") != other).alias("changed"))


def lookup_assessment(s, d):
    t = V.lookups(s, d).withColumn("area_m2", 1000.0 + F.col("lookup_id") % 5000)
    a = S.assess(t)
    return a.groupBy(F.coalesce("verdict", F.lit("not assessed")).alias("verdict")).agg(F.count(F.lit(1)).alias("lookups"), F.round(F.sum("volume_m3"), 2).alias("volume_m3"))


def confidence_ladder(s, d):
    e = V.table(s, d, "events").select("user_id", (F.col("value") / 1000).alias("confidence"))
    return S.confidence_ladder(e, "user_id")


def ndwi_pixels(s, d):
    return V.pixels(s, d).select("chip_id", "row", "col", F.round(B.ndwi("green", "nir"), 6).alias("ndwi"))


def ndwi_chip_stats(s, d):
    c = R.chip_stats(V.pixels(s, d), "chip_id")
    return c.select("chip_id", "pixels", "water_pixels", F.round("water_fraction", 6).alias("water_fraction"), F.round("mean_ndwi", 6).alias("mean_ndwi"))


def ndwi_heat(s, d):
    h = V.pixels(s, d).select("chip_id", "row", "col", B.heat(F.round(B.ndwi("green", "nir"), 6)).alias("h"))
    return h.select("chip_id", "row", "col", "h.r", "h.g", "h.b")


def percentile_stretch(s, d):
    p = V.pixels(s, d).select("chip_id", "row", "col", F.round("green", 4).alias("v"))
    return R.percentile_stretch(p, ["chip_id"], "v").select("chip_id", "row", "col", "stretched")


def finite_stretch(s, d):
    v = F.when(F.col("row") == F.col("col"), F.lit(float("nan"))).otherwise(F.round("nir", 4))
    p = V.pixels(s, d).select("chip_id", "row", "col", v.alias("v")).where(~F.isnan("v") | (F.col("row") == 0))
    return R.percentile_stretch(p, ["chip_id"], "v", True).where(~F.isnan("v")).select("chip_id", "row", "col", "stretched")


def reflectance_bands(s, d):
    b = B.three_bands(F.array(F.col("l_partkey"), F.col("l_suppkey")))
    return V.table(s, d, "lineitem").select(*_KEYS, F.round(B.reflectance("l_partkey"), 6).alias("reflectance"), b[2].alias("third_band"), B.reversed_bands(b)[0].alias("first_reversed"))


def _masks(s, d):
    return V.pixels(s, d).select("chip_id", "row", "col", F.when(B.ndwi("green", "nir") > 0, 255).otherwise(0).alias("value"))


def mask_audit(s, d):
    a = R.mask_audit(_masks(s, d), "chip_id", 8, 8)
    return a.select("chip_id", "positive_pixels", F.round("foreground_frac", 6).alias("foreground_frac"), "touches_border")


def mask_flagged_ratio(s, d):
    return R.flagged_ratio(R.mask_audit(_masks(s, d), "chip_id", 8, 8)).withColumn("ratio", F.round("ratio", 6))


def mask_components(s, d):
    return R.component_counts(_masks(s, d), "chip_id")


def water_polygons(s, d):
    w = R.water_polygons(V.pixels(s, d), "chip_id", smallest=4.0).select("chip_id", F.posexplode("detections").alias("at", "d"))
    return w.select("chip_id", "at", F.size("d.mask_polygon").alias("corners"), "d.confidence", F.round(G.area_px("d.mask_polygon"), 2).alias("area_px"))


def mask_labels(s, d):
    m = R.mask_polygons(_masks(s, d), "chip_id", outer_only=True, smallest=4.0).select("chip_id", F.posexplode("polygons").alias("at", "p"))
    return m.select("chip_id", "at", G.label_line(G.to_flat("p", F.lit(8), F.lit(8))).alias("line"))


def flood_detections(s, d):
    bands = V.pixels(s, d).groupBy("chip_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "green", "nir"))).alias("p"))
    g, n = F.transform("p", lambda x: x["green"]), F.transform("p", lambda x: x["nir"])
    path = F.when(F.col("chip_id") % 3 == 0, "a.TIF").when(F.col("chip_id") % 3 == 1, "a.tiff").otherwise("a.png")
    r = bands.select("chip_id", path.alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(F.col("chip_id") % 5 == 0, F.array(g)).otherwise(F.array(g, g, n, n)).alias("bands"))
    return predict_floods(r, "chip_id").select("chip_id", F.size("detections").alias("detections"))


def image_hashes(s, d):
    p = V.pixels(s, d).select("chip_id", "row", "col", F.round(F.col("green") * 100, 4).alias("value"))
    return R.perceptual_hashes(p, "chip_id")


def _boxes(s, d):
    t = V.table(s, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("w"), (F.col("p_partkey") % 17 + 1.0).alias("h"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    return t.withColumn("polygon", F.array(corner(z, z), corner(F.col("w"), z), corner(F.col("w"), F.col("h")), corner(z, F.col("h") + 1)))


def polygon_area(s, d):
    b = _boxes(s, d)
    return b.select("p_partkey", G.area_px("polygon").alias("area_px"), F.round(G.perimeter("polygon"), 6).alias("perimeter"), G.area_m2("polygon", F.when(F.col("p_partkey") % 2 == 0, 30.0)).alias("area_m2"))


def polygon_overlap(s, d):
    b = _boxes(s, d)
    shifted = F.transform("polygon", lambda c: F.struct((c["x"] + F.col("w") / 2).alias("x"), c["y"].alias("y")))
    return b.select("p_partkey", F.round(R.polygon_iou(F.array("polygon"), F.array(shifted)), 6).alias("iou"))


def stub_detection_area(s, d):
    i = V.table(s, d, "part").select("p_partkey", (F.col("p_size") + 64).alias("height"), (F.col("p_partkey") % 100 + 64).alias("width"))
    t = i.select(F.concat(F.lit("chip"), F.col("p_partkey").cast("string")).alias("stem"), G.stub_detection("height", "width").alias("detections"))
    return S.scars_of(t, 30.0).select("scar_id", "confidence", F.round("area_m2", 3).alias("area_m2"))


def label_text(s, d):
    b = _boxes(s, d)
    return b.select("p_partkey", G.label_line(G.to_flat("polygon", F.lit(64), F.lit(32))).alias("line"))


def label_parse(s, d):
    t = V.table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.format_string("%d %.6f 0.250000 %.6f 0.750000 0.5 1.0", F.col("p_size"), F.col("p_size") / 64, (F.col("p_partkey") % 64) / 64)).alias("line"))
    p = t.select("p_partkey", G.parse_label("line").alias("l")).where("l is not null").select("p_partkey", "l.label", F.posexplode(G.from_flat("l.flat", F.lit(64), F.lit(32))).alias("at", "c"))
    return p.select("p_partkey", "label", "at", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


def local_relief_grid(s, d):
    g = V.dem(s, d)
    p = g.select(F.concat_ws("_", "row", "col").alias("cell"), "area", "row", "col")
    return H.local_relief(p, g, "cell", 2).select("cell", F.round("relief", 6).alias("relief"))


def d8_direction(s, d):
    return H.flow_directions(V.dem(s, d)).select("row", "col", "direction")


def flow_accumulation(s, d):
    return H.flow_accumulation(H.flow_directions(V.dem(s, d))).select("row", "col", "accumulation")


def channel_graph(s, d):
    n = H.channel_nodes(H.flow_accumulation(H.flow_directions(V.dem(s, d))), 20)
    return H.channel_edges(n, size_x=20.0, size_y=30.0).select("row", "col", "to_row", "to_col", F.round("distance_m", 6).alias("distance_m"))


def channel_summary(s, d):
    nodes, edges = _graph(s, d)
    g = H.graph_summary(nodes, edges)
    return g.withColumn("max_upstream_area_km2", F.round("max_upstream_area_km2", 6))


def _graph(s, d):
    """Grid to graph: filled, drained, channels, nodes and edges."""
    grid = s.range(1).select(F.lit("a").alias("area"), D.grid_from_centres(F.lit(85.0), F.lit(28.0), F.lit(0.0003), F.lit(0.00025)).alias("transform"), F.lit(50).alias("height"))
    return H.drainage_graph(V.slope(s, d), grid, threshold=20)


def drainage_nodes(s, d):
    n = _graph(s, d)[0]
    return n.select("node", "row", "col", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "upstream_area_km2")])


def drainage_edges(s, d):
    return _graph(s, d)[1].select("src", "dst", F.round("dist", 5).alias("dist"))


def terrain_lookup(s, d):
    """Lookups over the forest's nodes and the grid of parts; one in ten lies outside of the grid and takes the area's fallback."""
    nodes = V.forest(s, d)[0].select(F.lit("a").alias("area"), "node", "lat", "lon", (F.col("node") * 0.5).alias("upstream_area_km2"))
    out = F.col("lookup_id") % 10 == 0
    p = _points(s, d).select(F.lit("a").alias("area"), "*", F.when(~out, (F.col("lookup_id") % 45).cast("int")).alias("row"), F.when(~out, (F.col("lookup_id") % 40).cast("int")).alias("col"))
    areas = s.range(1).select(F.lit("a").alias("name"), F.lit(500.0).alias("local_relief_fallback_m"))
    t = H.lookup_terrain(p, nodes, V.dem(s, d), areas, "lookup_id", "node", 2)
    return t.select("lookup_id", "node", "upstream_area_km2", F.round("local_relief_m", 6).alias("local_relief_m"), "local_relief_is_real", F.round("distance_to_channel_km", 5).alias("distance_to_channel_km"))


def skipped_detections(s, d):
    """Boxes, some of them on one line or with two corners only."""
    box = lambda *c: F.struct(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in c]).alias("mask_polygon"))
    whole, flat, stub = box((0, 0), (4, 0), (4, 3)), box((0, 0), (1, 1), (2, 2)), box((0, 0), (4, 0))
    t = V.table(s, d, "part").select("p_partkey", F.array(whole, F.when(F.col("p_partkey") % 2 == 0, flat).otherwise(whole), F.when(F.col("p_partkey") % 5 == 0, stub).otherwise(whole)).alias("detections"))
    return S.skipped(t, "p_partkey")


def slide_detections(s, d):
    i = V.table(s, d, "part").select("p_partkey", (F.col("p_size") + 64).alias("height"), (F.col("p_partkey") % 100 + 64).alias("width"))
    p = predict_slides(i, "p_partkey").select("p_partkey", F.inline("detections"))
    return p.select("p_partkey", F.size("mask_polygon").alias("corners"), "confidence", "class", F.col("mask_polygon")[0]["x"].alias("x"), F.col("mask_polygon")[0]["y"].alias("y"))


def validation_cases(s, d):
    """Parts as cases: a box of the part's size with a confidence, and a flood over half of it."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, z, h = F.col("p_size"), F.lit(0), F.lit(10)
    box = lambda a: F.array(corner(z + a, z), corner(w + a, z), corner(w + a, h), corner(z + a, h))
    one = lambda a, c: F.array(F.struct(box(a).alias("mask_polygon"), c.alias("confidence"), F.lit("x").alias("class")))
    p = V.table(s, d, "part").withColumnRenamed("p_partkey", "case")
    found = p.select("case", one(z, (F.col("case") % 40) / 100.0).alias("detections"))
    floods = p.select("case", F.when(F.col("case") % 3 == 0, F.slice(one(z, F.lit(1.0)), 1, 0)).otherwise(one(w / 2, F.lit(1.0))).alias("detections"))
    r = run_cases(p.select("case", (w * 0.5).alias("upstream_area_km2"), F.lit(None).cast("double").alias("local_relief_m")), found, floods)
    return r.select("case", "level", "n_detections", "n_scars", F.get("verdicts", F.lit(0)).alias("verdict"), "n_floods", F.round("iou", 6).alias("iou"))


def filled_drainage(s, d):
    return H.drained(V.dem(s, d)).select("row", "col", "direction", "accumulation")


def fill_depressions(s, d):
    return H.fill_depressions(V.dem(s, d)).select("row", "col", F.round("filled", 6).alias("filled"))


def _starts(s, d):
    return V.forest(s, d)[0].select(F.col("node").alias("start"), F.col("node"))


def downstream_walk(s, d):
    _, edges = V.forest(s, d)
    return walk(_starts(s, d), edges, "start", "node", 1e12).select("start", "seq", "node", F.col("dist").alias("dist_m"))


def downstream_clip(s, d):
    nodes, edges = V.forest(s, d)
    w = H.downstream(_starts(s, d), nodes, edges, "start", "node", 0.25)
    return w.select("start", "seq", "node", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("distance_km", 6).alias("distance_km"))


def dag_check(s, d):
    _, edges = V.forest(s, d)
    ok = is_acyclic(edges)
    return edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("acyclic", F.lit(ok))


def _points(s, d):
    t = V.lookups(s, d).where("lat is not null and lon is not null")
    return t.select("lookup_id", (27.5 + F.abs("lat") % 1).alias("lat"), (84.5 + F.abs("lon") % 1 * 0.15).alias("lon"))


def nearest_channel(s, d):
    nodes, _ = V.forest(s, d)
    return H.nearest(_points(s, d), nodes, "lookup_id", "node").select("lookup_id", "node")


def channel_distance_km(s, d):
    nodes, _ = V.forest(s, d)
    return H.channel_distance_km(_points(s, d), nodes, "lookup_id", "node").select("lookup_id", F.round("distance_km", 5).alias("distance_km"))


def cell_geometry(s, d):
    a = V.table(s, d, "study_areas").select("name", D.grid_from_centres(F.col("bbox")[0], F.col("bbox")[3], F.lit(0.0003), F.lit(0.00025)).alias("t"))
    c = a.select("name", D.cell_size("t", F.lit(3600)).alias("c"), D.pixel_centre("t", F.lit(10), F.lit(20)).alias("p"), D.pixel_of("t", F.col("t")[2] + 0.0061, F.col("t")[5] - 0.0051).alias("q"))
    return c.select("name", *[F.round(f"c.{k}", 6).alias(k) for k in ("x_m", "y_m", "area_km2")], F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.col("q.row").alias("row"), F.col("q.col").alias("col"))


def utm_round_trip(s, d):
    a = V.table(s, d, "study_areas").select("name", "utm_crs", ((F.col("bbox")[1] + F.col("bbox")[3]) / 2).alias("lat"), F.col("bbox")[0].alias("lon"))
    u = a.withColumn("u", D.to_utm("lat", "lon", "utm_crs")).withColumn("b", D.from_utm("u.x", "u.y", "utm_crs"))
    return u.select("name", F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"), (F.abs(F.col("b.lat") - F.col("lat")) < 1e-9).alias("lat_back"), (F.abs(F.col("b.lon") - F.col("lon")) < 1e-9).alias("lon_back"))


def ground_resolution(s, d):
    a = V.table(s, d, "study_areas").select("name", F.concat("name", F.when(F.length("name") % 2 == 0, ".TIF").otherwise(".jpg")).alias("path"), D.grid_from_centres(F.col("bbox")[0], F.col("bbox")[3], F.lit(0.0003), F.lit(0.00025)).alias("t"))
    args = ("path", "t", F.lit(512), F.lit(256), F.lit("EPSG:4326"))
    g = a.select("name", D.ground_resolution(*args, 12.5).alias("g"), D.image_centre(*args).alias("c"))
    return g.select("name", F.round("g.gsd", 4).alias("gsd"), "g.source", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


_NAMES = (
    "scar_assessment scar_verdict_counts relief_cap_effect lookup_assessment confidence_ladder ndwi_pixels ndwi_chip_stats ndwi_heat percentile_stretch finite_stretch reflectance_bands "
    "mask_audit mask_flagged_ratio mask_components water_polygons mask_labels flood_detections image_hashes polygon_area polygon_overlap stub_detection_area label_text label_parse "
    "local_relief_grid d8_direction flow_accumulation channel_graph channel_summary filled_drainage fill_depressions downstream_walk downstream_clip dag_check drainage_nodes drainage_edges terrain_lookup skipped_detections slide_detections validation_cases nearest_channel channel_distance_km "
    "cell_geometry utm_round_trip ground_resolution"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_MASKS = f"{V.PIXELS}, masks AS (SELECT chip_id, row, col, CASE WHEN ndwi > 0 THEN 255 ELSE 0 END AS value FROM indexed)"
_AUDIT = f"{_MASKS}, audit AS (SELECT chip_id, count(*) FILTER (WHERE value > 127) AS positive_pixels, count(*) FILTER (WHERE value > 127) / 64 AS foreground_frac, coalesce(bool_or(value > 127 AND (row IN (0, 7) OR col IN (0, 7))), false) AS touches_border FROM masks GROUP BY chip_id)"
_BOXES = "boxes AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS w, p_partkey % 17 + 1.0::DOUBLE AS h FROM part)"
_STEPS = "step(k, dr, dc, nth) AS (VALUES (64, -1, 0, 0), (128, -1, 1, 1), (1, 0, 1, 2), (2, 1, 1, 3), (4, 1, 0, 4), (8, 1, -1, 5), (16, 0, -1, 6), (32, -1, -1, 7))"
_D8 = f"""{V.DEM}, {_STEPS},
falls AS (SELECT a.row, a.col, k, nth, (a.elev - b.elev) / sqrt(dr * dr + dc * dc) AS slope FROM dem a, step JOIN dem b ON b.row = a.row + dr AND b.col = a.col + dc),
best AS (SELECT row, col, arg_min(k, (-slope, nth)) AS k FROM falls WHERE slope > 0 GROUP BY row, col),
flow AS (SELECT a.row, a.col, coalesce(k, 0)::INT AS direction FROM dem a LEFT JOIN best USING (row, col)),
next AS (SELECT f.row, f.col, g.row AS to_row, g.col AS to_col, direction FROM flow f JOIN step ON k = direction JOIN dem g ON g.row = f.row + dr AND g.col = f.col + dc)"""
_ACC = f"""WITH RECURSIVE {_D8},
way(row, col, r, c) AS (SELECT row, col, row, col FROM dem UNION ALL SELECT w.row, w.col, n.to_row, n.to_col FROM way w JOIN next n ON n.row = w.r AND n.col = w.c),
acc AS (SELECT r AS row, c AS col, count(*) AS accumulation FROM way GROUP BY r, c),
chan AS (SELECT * FROM acc WHERE accumulation > 20),
links AS (SELECT n.* FROM next n JOIN chan a USING (row, col) JOIN chan b ON b.row = n.to_row AND b.col = n.to_col)"""
_GRAPH = f"""{_ACC.replace(V.DEM, V.SLOPE)}, cell AS (SELECT 0.0003::DOUBLE * 111320 * cos(radians(28.0::DOUBLE + 0.00025::DOUBLE / 2 - 0.00025::DOUBLE * 50 / 2)) AS x_m, 0.00025::DOUBLE * 111320 AS y_m)"""
_WALK = f"""WITH RECURSIVE {V.FOREST},
way(start, seq, node, dist) AS (SELECT node, 0, node, 0.0::DOUBLE FROM nodes UNION ALL SELECT w.start, w.seq + 1, e.dst, w.dist + e.dist FROM way w JOIN edges e ON e.src = w.node)"""
_POINTS = f"{V.FOREST}, {V.LOOKUPS}, points AS (SELECT lookup_id, 27.5 + abs(lat) % 1 AS lat, 84.5 + abs(lon) % 1 * 0.15 AS lon FROM lookups WHERE lat IS NOT NULL AND lon IS NOT NULL)"
_NEAREST = f"{_POINTS}, near AS (SELECT lookup_id, arg_min(node, ((p.lat - n.lat) * (p.lat - n.lat) + (p.lon - n.lon) * (p.lon - n.lon), node)) AS node FROM points p, nodes n GROUP BY lookup_id)"



def utm_sql(source: str, name: str) -> str:
    """A table name of all columns of source (with lat, lon, crs) and x, y in metres of the UTM zone that crs names."""
    terms = list(enumerate(D._FORWARD, 1))
    east = " + ".join(f"({c!r}::DOUBLE) * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in terms)
    north = " + ".join(f"({c!r}::DOUBLE) * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in terms)
    e, scale = f"{D._ECC!r}::DOUBLE", f"{D.SCALE * D._RECTIFYING!r}::DOUBLE"
    return f"""{name}_1 AS (SELECT *, sin(radians(lat)) AS s_, radians(lon - (right(crs, 2)::INT * 6 - 183)) AS lam_ FROM {source}),
{name}_2 AS (SELECT *, sinh(atanh(s_) - {e} * atanh({e} * s_)) AS t_ FROM {name}_1),
{name}_3 AS (SELECT *, atan2(t_, cos(lam_)) AS xi, asinh(sin(lam_) / sqrt(t_ * t_ + cos(lam_) * cos(lam_))) AS eta FROM {name}_2),
{name} AS (SELECT * EXCLUDE (s_, lam_, t_, xi, eta), 500000 + {scale} * (eta + {east}) AS x, CASE WHEN contains(crs, ':327') THEN 10000000 ELSE 0 END + {scale} * (xi + {north}) AS y FROM {name}_3)"""


SQL = {
    "utm_round_trip": f"""WITH a AS (SELECT name, utm_crs AS crs, (bbox[2] + bbox[4]) / 2 AS lat, bbox[1] AS lon FROM study_areas), {utm_sql("a", "u")}
SELECT name, round(x, 3) AS x, round(y, 3) AS y, true AS lat_back, true AS lon_back FROM u""",
    "scar_assessment": f"WITH {V.SCARS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(volume, 6) AS volume_m3, round(height, 6) AS dam_height_m, round(dbi, 6) AS dbi, verdict FROM judged",
    "scar_verdict_counts": f"WITH {V.SCARS} SELECT verdict, count(*) AS scars, round(avg(dbi), 6) AS mean_dbi FROM judged GROUP BY verdict",
    "relief_cap_effect": f"""WITH {V.SCARS}, free AS (SELECT *, log10(q * pow(volume, 1.0 / 3) / (volume / 1e6)) AS f FROM judged)
SELECT count(*) FILTER (WHERE height < pow(volume, 1.0 / 3)) AS capped, count(*) FILTER (WHERE verdict <> CASE WHEN f < 2.75 THEN 'stable' WHEN f <= 3.08 THEN 'uncertain' ELSE 'breach_risk' END) AS changed FROM free""",
    "lookup_assessment": f"""WITH {V.LOOKUPS}, v AS (SELECT *, 0.146 * pow(1000.0 + lookup_id % 5000, 1.332) AS volume FROM lookups),
h AS (SELECT *, CASE WHEN local_relief_m IS NULL THEN pow(volume, 1.0 / 3) ELSE least(pow(volume, 1.0 / 3), local_relief_m) END AS height FROM v),
d AS (SELECT *, CASE WHEN upstream_area_km2 > 0 AND height > 0 THEN log10(upstream_area_km2 * height / (volume / 1e6)) END AS dbi FROM h)
SELECT CASE WHEN dbi < 2.75 THEN 'stable' WHEN dbi <= 3.08 THEN 'uncertain' WHEN dbi IS NOT NULL THEN 'breach_risk' ELSE 'not assessed' END AS verdict, count(*) AS lookups, round(sum(volume), 2) AS volume_m3 FROM d GROUP BY 1""",
    "confidence_ladder": """WITH n AS (SELECT user_id, count(*) FILTER (WHERE value / 1000 >= 0.25) AS a, count(*) FILTER (WHERE value / 1000 >= 0.05) AS b, count(*) FILTER (WHERE value / 1000 >= 0.01) AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a > 0 THEN 0.25::DOUBLE WHEN b > 0 THEN 0.05::DOUBLE WHEN c > 0 THEN 0.01::DOUBLE END AS level, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS n FROM n""",
    "ndwi_pixels": f"WITH {V.PIXELS} SELECT chip_id, row, col, round(ndwi, 6) AS ndwi FROM indexed",
    "ndwi_chip_stats": f"WITH {V.PIXELS} SELECT chip_id, count(*) AS pixels, count(*) FILTER (WHERE ndwi > 0) AS water_pixels, round(count(*) FILTER (WHERE ndwi > 0) / count(*), 6) AS water_fraction, round(avg(ndwi), 6) AS mean_ndwi FROM indexed GROUP BY chip_id",
    "ndwi_heat": f"WITH {V.PIXELS}, t AS (SELECT *, (least(greatest(round(ndwi, 6), -1.0), 1.0) + 1) / 2 AS t FROM indexed) SELECT chip_id, row, col, floor((1 - t) * 255)::INT AS r, 0 AS g, floor(t * 255)::INT AS b FROM t",
    "percentile_stretch": f"""WITH {V.PIXELS}, v AS (SELECT chip_id, row, col, round(green, 4) AS v FROM pixels), p AS (SELECT chip_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY chip_id)
SELECT chip_id, row, col, floor(least(greatest((v - lo) / (hi - lo + 1e-9) * 255, 0.0), 255.0))::INT AS stretched FROM v JOIN p USING (chip_id)""",
    "finite_stretch": f"""WITH {V.PIXELS}, v AS (SELECT chip_id, row, col, round(nir, 4) AS v FROM pixels WHERE row <> col), p AS (SELECT chip_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY chip_id)
SELECT chip_id, row, col, floor(least(greatest((v - lo) / (hi - lo + 1e-9), 0.0), 1.0) * 255)::INT AS stretched FROM v JOIN p USING (chip_id)""",
    "reflectance_bands": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_partkey * 0.0000275::DOUBLE - 0.2::DOUBLE, 6) AS reflectance, l_partkey AS third_band, l_partkey AS first_reversed FROM lineitem",
    "mask_audit": f"WITH {_AUDIT} SELECT chip_id, positive_pixels, round(foreground_frac, 6) AS foreground_frac, touches_border FROM audit",
    "mask_flagged_ratio": f"WITH {_AUDIT} SELECT count(*) FILTER (WHERE touches_border) AS flagged, count(*) AS total, round(count(*) FILTER (WHERE touches_border) / count(*), 6) AS ratio FROM audit",
    "mask_components": f"""WITH RECURSIVE {_MASKS}, fg AS (SELECT chip_id, row, col, row * 8 + col AS p FROM masks WHERE value > 127),
link AS (SELECT a.chip_id, a.p, b.p AS q FROM fg a JOIN fg b ON a.chip_id = b.chip_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach(chip_id, p, q) AS (SELECT chip_id, p, p FROM fg UNION SELECT r.chip_id, r.p, l.q FROM reach r JOIN link l ON l.chip_id = r.chip_id AND l.p = r.q),
root AS (SELECT chip_id, p, min(q) AS r FROM reach GROUP BY chip_id, p)
SELECT c.chip_id, count(DISTINCT r)::INT AS n_components FROM (SELECT DISTINCT chip_id FROM masks) c LEFT JOIN root ON root.chip_id = c.chip_id GROUP BY c.chip_id""",
    "polygon_area": f"WITH {_BOXES} SELECT p_partkey, (w * h + w * (h + 1)) / 2 AS area_px, round(w + h + sqrt(w * w + 1) + h + 1, 6) AS perimeter, (w * h + w * (h + 1)) / 2 * CASE WHEN p_partkey % 2 = 0 THEN 900.0::DOUBLE ELSE 100.0::DOUBLE END AS area_m2 FROM boxes",
    "polygon_overlap": f"WITH {_BOXES}, o AS (SELECT p_partkey, w * (h + 0.5::DOUBLE) AS a, w / 2 * (h + 1) - 3 * w / 8 AS i FROM boxes) SELECT p_partkey, round(i / (2 * a - i), 6) AS iou FROM o",
    "stub_detection_area": """WITH i AS (SELECT p_partkey, (p_size + 64)::DOUBLE AS h, (p_partkey % 100 + 64)::DOUBLE AS w FROM part),
c AS (SELECT p_partkey, [-1.0, -0.4, 0.5, 1.0, 0.3, -0.6][k]::DOUBLE * (w * 0.22::DOUBLE) + w * 0.55::DOUBLE AS x, [-0.3, -1.0, -0.6, 0.2, 1.0, 0.7][k]::DOUBLE * (h * 0.16::DOUBLE) + h * 0.5::DOUBLE AS y, k FROM i, range(1, 7) r(k)),
p AS (SELECT p_partkey, k, round(x, 1) AS x, round(y, 1) AS y FROM c),
n AS (SELECT *, lead(x, 1, first_x) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2 FROM (SELECT *, first_value(x) OVER v AS first_x, first_value(y) OVER v AS first_y FROM p WINDOW v AS (PARTITION BY p_partkey ORDER BY k)) WINDOW w AS (PARTITION BY p_partkey ORDER BY k))
SELECT 'chip' || p_partkey || '-scar0' AS scar_id, 0.87::DOUBLE AS confidence, round(abs(sum(x * y2 - x2 * y)) / 2 * 900, 3) AS area_m2 FROM n GROUP BY p_partkey""",
    "label_text": f"""WITH {_BOXES} SELECT p_partkey, printf('0 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', 0.0::DOUBLE, 0.0::DOUBLE, round(w / 64, 6), 0.0::DOUBLE, round(w / 64, 6), round(h / 32, 6), 0.0::DOUBLE, round((h + 1) / 32, 6)) AS line FROM boxes""",
    "label_parse": """WITH l AS (SELECT p_partkey, string_split(printf('%d %.6f 0.250000 %.6f 0.750000 0.5 1.0', p_size, p_size / 64, (p_partkey % 64) / 64), ' ') AS f FROM part WHERE p_partkey % 10 <> 0)
SELECT p_partkey, f[1]::INT AS label, k::INT AS "at", round(f[2 + 2 * k]::DOUBLE * 64, 4) AS x, round(f[3 + 2 * k]::DOUBLE * 32, 4) AS y FROM l, range(0, 3) r(k)""",
    "local_relief_grid": f"WITH {V.DEM} SELECT a.row || '_' || a.col AS cell, round(max(b.elev) - min(b.elev), 6) AS relief FROM dem a JOIN dem b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col",
    "d8_direction": f"WITH {_D8} SELECT row, col, direction FROM flow",
    "flow_accumulation": f"{_ACC} SELECT row, col, accumulation FROM acc",
    "channel_graph": f"{_ACC} SELECT row, col, to_row, to_col, round(CASE WHEN direction IN (128, 2, 8, 32) THEN sqrt(1300.0::DOUBLE) WHEN direction IN (64, 4) THEN 30.0 ELSE 20.0 END, 6) AS distance_m FROM links",
    "channel_summary": f"{_GRAPH} SELECT 'a' AS area, (SELECT count(*) FROM chan) AS n_nodes, (SELECT count(*) FROM links) AS n_edges, (SELECT round(max(accumulation) * x_m * y_m / 1e6, 6) FROM chan, cell GROUP BY x_m, y_m) AS max_upstream_area_km2 WHERE EXISTS (SELECT 1 FROM chan)",
    "drainage_nodes": f"{_GRAPH} SELECT 'a:' || row || ':' || col AS node, row, col, round(28.0::DOUBLE - 0.00025::DOUBLE * row, 6) AS lat, round(85.0::DOUBLE + 0.0003::DOUBLE * col, 6) AS lon, round(accumulation * x_m * y_m / 1e6, 6) AS upstream_area_km2 FROM chan, cell",
    "drainage_edges": f"{_GRAPH} SELECT 'a:' || row || ':' || col AS src, 'a:' || to_row || ':' || to_col AS dst, round(CASE WHEN direction IN (128, 2, 8, 32) THEN sqrt(x_m * x_m + y_m * y_m) WHEN direction IN (64, 4) THEN y_m ELSE x_m END, 5) AS dist FROM links, cell",
    "terrain_lookup": f"""WITH {V.DEM}, {_NEAREST}, spot AS (SELECT p.*, CASE WHEN lookup_id % 10 <> 0 THEN lookup_id % 45 END AS row, CASE WHEN lookup_id % 10 <> 0 THEN lookup_id % 40 END AS col FROM points p),
relief AS (SELECT row, col, (SELECT max(elev) - min(elev) FROM dem d WHERE abs(d.row - r.row) <= 2 AND abs(d.col - r.col) <= 2) AS relief FROM (SELECT DISTINCT row, col FROM spot WHERE row IS NOT NULL) r)
SELECT lookup_id, node, node * 0.5::DOUBLE AS upstream_area_km2, round(coalesce(relief, 500.0), 6)::DOUBLE AS local_relief_m, relief IS NOT NULL AS local_relief_is_real,
round(sqrt((n.lat - p.lat) * (n.lat - p.lat) + ((n.lon - p.lon) * cos(radians(p.lat))) * ((n.lon - p.lon) * cos(radians(p.lat)))) * 111.32, 5) AS distance_to_channel_km
FROM spot p JOIN near USING (lookup_id) JOIN nodes n USING (node) LEFT JOIN relief ON relief.row = p.row AND relief.col = p.col""",
    "skipped_detections": "SELECT p_partkey, ((p_partkey % 2 = 0)::INT + (p_partkey % 5 = 0)::INT)::INT AS n_skipped FROM part",
    "slide_detections": "WITH i AS (SELECT p_partkey, (p_size + 64)::DOUBLE AS h, (p_partkey % 100 + 64)::DOUBLE AS w FROM part) SELECT p_partkey, 6 AS corners, 0.87::DOUBLE AS confidence, 'landslide' AS class, round(w * 0.55::DOUBLE + w * 0.22::DOUBLE * -1.0::DOUBLE, 1) AS x, round(h * 0.5::DOUBLE + h * 0.16::DOUBLE * -0.3::DOUBLE, 1) AS y FROM i",
    "validation_cases": """WITH c AS (SELECT p_partkey AS "case", p_size * 0.5 AS q, (p_partkey % 40) / 100.0::DOUBLE AS sure, 0.146 * pow(p_size * 10 * 900.0, 1.332) AS v, p_partkey % 3 <> 0 AS flooded FROM part),
j AS (SELECT *, log10(q * pow(v, 1.0 / 3) / (v / 1e6)) AS dbi FROM c)
SELECT "case", CASE WHEN sure >= 0.25 THEN 0.25::DOUBLE WHEN sure >= 0.05 THEN 0.05::DOUBLE WHEN sure >= 0.01 THEN 0.01::DOUBLE END AS level, (sure >= 0.01)::BIGINT AS n_detections, (sure >= 0.25)::INT AS n_scars,
CASE WHEN sure < 0.25 THEN NULL WHEN dbi < 2.75 THEN 'stable' WHEN dbi <= 3.08 THEN 'uncertain' ELSE 'breach_risk' END AS verdict, flooded::INT AS n_floods, CASE WHEN sure >= 0.25 AND flooded THEN round(1.0::DOUBLE / 3, 6) END AS iou FROM j""",
    "downstream_walk": f"{_WALK} SELECT start, seq, node, dist AS dist_m FROM way",
    "downstream_clip": f"""{_WALK}, here AS (SELECT w.*, n.lat, n.lon, lag(dist) OVER k AS d0, lag(n.lat) OVER k AS lat0, lag(n.lon) OVER k AS lon0 FROM way w JOIN nodes n USING (node) WINDOW k AS (PARTITION BY start ORDER BY seq))
SELECT start, seq, CASE WHEN dist <= 250 THEN node END AS node, round((CASE WHEN dist <= 250 THEN lat ELSE lat0 + (250 - d0) / (dist - d0) * (lat - lat0) END)::VARCHAR::DECIMAL(30, 20), 6)::DOUBLE AS lat, round((CASE WHEN dist <= 250 THEN lon ELSE lon0 + (250 - d0) / (dist - d0) * (lon - lon0) END)::VARCHAR::DECIMAL(30, 20), 6)::DOUBLE AS lon,
round(CASE WHEN dist <= 250 THEN dist / 1000 ELSE 0.25 END, 6) AS distance_km FROM here WHERE d0 IS NULL OR d0 < 250""",
    "dag_check": f"{_WALK} SELECT count(*) AS edges, (SELECT max(seq) FROM way) <= count(*) AS acyclic FROM edges",
    "nearest_channel": f"WITH {_NEAREST} SELECT lookup_id, node FROM near",
    "channel_distance_km": f"WITH {_NEAREST} SELECT lookup_id, round(sqrt((n.lat - p.lat) * (n.lat - p.lat) + ((n.lon - p.lon) * cos(radians(p.lat))) * ((n.lon - p.lon) * cos(radians(p.lat)))) * 111.32, 5) AS distance_km FROM near JOIN points p USING (lookup_id) JOIN nodes n USING (node)",
    "cell_geometry": """WITH t AS (SELECT name, bbox[1] - 0.0003::DOUBLE / 2 AS c, bbox[4] + 0.00025::DOUBLE / 2 AS f FROM study_areas)
SELECT name, round(0.0003::DOUBLE * 111320 * cos(radians(f - 0.00025::DOUBLE * 3600 / 2)), 6) AS x_m, round(0.00025::DOUBLE * 111320, 6) AS y_m, round(0.0003::DOUBLE * 111320 * cos(radians(f - 0.00025::DOUBLE * 3600 / 2)) * (0.00025::DOUBLE * 111320) / 1e6, 6) AS area_km2,
round(0.0003::DOUBLE * 20.5 + c, 6) AS px, round(f - 0.00025::DOUBLE * 10.5, 6) AS py, 20 AS row, 20 AS col FROM t""",
}
