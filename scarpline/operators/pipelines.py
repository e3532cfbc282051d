"""Whole chains: from images to scars, from scars to ranked assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions import physics as P
from scarpline.functions.geodesy import to_utm
from scarpline.operators import exposure as X
from scarpline.operators import hydrology as H
from scarpline.operators import raster as R
from scarpline.operators import scars as S


def propagate_exposure(scars: DataFrame, nodes: DataFrame, edges: DataFrame, pieces: DataFrame, assets: DataFrame, key: str = "scar_id", node: str = "node", radius_km: float = C.EXPOSURE_RADIUS_KM, decay_km: float = C.DECAY_KM) -> DataFrame:
    """Ranked assets along each scar's way down.

    scars (key, node, verdict, utm_crs); nodes (node, lat, lon); edges (src, dst, dist); pieces (asset_id, ax, ay, bx, by) in metres of
    the same zone; assets (asset_id, name, asset_type). A way of fewer than two points exposes nothing.
    """
    way = H.downstream(scars, nodes, edges, key, node, radius_km).join(scars.select(key, "utm_crs"), key)
    path = way.select(key, "seq", to_utm("lat", "lon", "utm_crs").alias("u")).select(key, "seq", "u.x", "u.y")
    ref = X.line_reference(X.segments(path, key), pieces, key, "asset_id")
    ref = ref.join(assets.select("asset_id", "name", "asset_type"), "asset_id").join(scars.select(key, "verdict"), key)
    return X.rank_assets(X.exposure(ref, key, "asset_id", P.verdict_base("verdict"), decay_km), key, "asset_id")


def run_cases(cases: DataFrame, detections: DataFrame, floods: DataFrame, gsd: Column | float = C.LANDSAT_GSD_M_PER_PX) -> DataFrame:
    """One row a case: cases (case, upstream_area_km2, local_relief_m), detections and floods (case, detections).

    level and n_weak tell from which confidence on there are detections; scars are those of at least 0.25 with an area, assessed;
    iou compares the first scar with the first flood polygon and is NULL without either.
    """
    each = detections.select("case", F.explode("detections").alias("d")).select("case", F.col("d.confidence").alias("confidence"))
    ladder = S.confidence_ladder(each, "case")
    strong = detections.select("case", F.filter("detections", lambda d: d["confidence"] >= C.CONFIDENCE).alias("detections"))
    scars = S.scars_of(strong, gsd, "case").join(cases, "case")
    done = S.assess(scars).groupBy("case").agg(
        F.array_sort(F.collect_list(F.struct("scar_no", "scar_id", "area_m2", "dbi", "verdict"))).alias("scars"), F.min_by("d.mask_polygon", "scar_no").alias("first")
    )
    out = cases.select("case").join(ladder, "case", "left").join(done, "case", "left").join(floods.select("case", F.get("detections", F.lit(0)).alias("flood"), F.size("detections").alias("n_floods")), "case", "left")
    both = F.col("first").isNotNull() & F.col("flood").isNotNull()
    one = lambda c: F.when(both, F.array(c))
    iou = R.polygon_iou(one(F.col("first")), one(F.col("flood.mask_polygon")))
    return out.select("case", "level", F.coalesce("n", F.lit(0)).alias("n_detections"), F.coalesce(F.size("scars"), F.lit(0)).alias("n_scars"), F.transform("scars", lambda s: s["verdict"]).alias("verdicts"), F.coalesce("n_floods", F.lit(0)).alias("n_floods"), F.when(both, iou).alias("iou"))
