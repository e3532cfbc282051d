"""Scars: from detections to assessed scars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions import physics as P
from scarpline.functions import polygon as G
from scarpline.functions.texts import scar_id


def assess(scars: DataFrame, strict: bool = False, relief: str | None = "local_relief_m") -> DataFrame:
    """scars (area_m2, upstream_area_km2, local_relief_m, ...) with volume_m3, dam_height_m, dbi and verdict.

    A NULL relief leaves the height uncapped. Values of 0 or less give NULLs, or an error in strict mode. One narrow stage, no shuffle.
    """
    d = scars.withColumn("volume_m3", P.volume_m3("area_m2", strict))
    d = d.withColumn("dam_height_m", P.dam_height_m("volume_m3", relief, strict))
    d = d.withColumn("dbi", P.blockage_index("upstream_area_km2", "dam_height_m", "volume_m3", strict))
    return d.withColumn("verdict", P.verdict("dbi"))


def scars_of(detections: DataFrame, gsd: Column | float | None = None, name: str = "stem") -> DataFrame:
    """One row for each detection of an image (name, detections): scar_id by its place among all detections, area_m2, confidence; areas of 0 are left out."""
    each = detections.select("*", F.posexplode("detections").alias("at", "d")).drop("detections")
    each = each.withColumn("scar_id", scar_id(F.col(name), F.col("at"))).withColumn("area_m2", G.area_m2(F.col("d")["mask_polygon"], gsd))
    return each.where("area_m2 > 0").withColumn("confidence", F.col("d")["confidence"]).withColumnRenamed("at", "scar_no")


def skipped(detections: DataFrame, name: str = "stem") -> DataFrame:
    """(name, n_skipped): how many detections have no area: fewer than three corners, or all on one line."""
    bad = F.filter("detections", lambda d: F.coalesce(G.area_px(d["mask_polygon"]), F.lit(0.0)) <= 0)
    return detections.select(name, F.coalesce(F.size(bad), F.lit(0)).alias("n_skipped"))


def confidence_ladder(detections: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    """(key, level, n): the first of the levels 0.25, 0.05, 0.01 that some detection reaches, and how many do; NULL and 0 if none does."""
    levels = (C.CONFIDENCE, *C.WEAKER_CONFIDENCES)
    reach = [F.count_if(F.col(confidence) >= v).alias(f"n{k}") for k, v in enumerate(levels)]
    level, n = F.lit(None).cast("double"), F.lit(0).cast("long")
    for k, v in reversed(list(enumerate(levels))):
        level, n = F.when(F.col(f"n{k}") > 0, F.lit(v)).otherwise(level), F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")).otherwise(n)
    return detections.groupBy(key).agg(*reach).select(key, level.alias("level"), n.alias("n"))
