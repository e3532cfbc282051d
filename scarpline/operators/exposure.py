"""Assets along a way down: joins by distance, linear referencing, decayed scores and ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scarpline import constants as C
from scarpline.functions import physics as P
from scarpline.functions.geodesy import to_utm
from scarpline.functions.geotext import POINT, RING, read_geometry
from scarpline.functions.texts import clean_name, poi_kind, road_kind


def assets(roads: DataFrame | None = None, pois: DataFrame | None = None) -> DataFrame:
    """(asset_id, area, name, asset_type, geometry) of roads (highway, bridge) and points of interest (amenity, place); either may be missing, others are left out."""
    parts = []
    if roads is not None:
        parts.append(roads.select("asset_id", "area", clean_name(F.col("name"), F.coalesce("highway", F.lit("road"))).alias("name"), road_kind("bridge").alias("asset_type"), "geometry"))
    if pois is not None:
        k = pois.withColumn("_kind", poi_kind("amenity", "place")).where("_kind <> 'other'")
        parts.append(k.select("asset_id", "area", clean_name("name", F.col("_kind")).alias("name"), F.col("_kind").alias("asset_type"), "geometry"))
    if not parts:
        raise ValueError("neither roads nor points of interest")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def degree_pieces(assets: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(key, lon0, lat0, lon1, lat1): the straight pieces of WKT or GeoJSON geometries; a point is a piece with equal ends. What is NULL, empty or unreadable has none."""
    kind = assets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for part, v in read_geometry(text):
                    closed = [*v, v[0]] if part == RING and v[0] != v[-1] else v
                    own = [(*p, *p) for p in v] if part == POINT or len(v) == 1 else [(*p, *q) for p, q in zip(closed, closed[1:])]
                    at += [k] * len(own)
                    rows += own
            cols = [pa.array([r[c] for r in rows], pa.float64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=[key, "lon0", "lat0", "lon1", "lat1"])

    return assets.select(key, geometry).where(f"`{geometry}` is not null").mapInArrow(run, f"`{key}` {kind}, lon0 double, lat0 double, lon1 double, lat1 double")


def pieces(assets: DataFrame, key: str, crs: Column | str, geometry: str = "geometry", zones: DataFrame | None = None, area: str = "area") -> DataFrame:
    """(key, ax, ay, bx, by): the straight pieces of each asset in metres of the UTM zone that crs names, for line_reference().

    With zones (area, crs), crs is that column's name and each asset takes the zone of its area; assets without one have no pieces.
    """
    d = degree_pieces(assets, key, geometry)
    if zones is not None:
        own = assets.select(key, area).distinct().join(zones.select(area, F.col(crs).alias("_crs")), area).select(key, "_crs")
        d = d.join(own, key)
        crs = F.col("_crs")
    d = d.select(key, to_utm("lat0", "lon0", crs).alias("a"), to_utm("lat1", "lon1", crs).alias("b")).where("a is not null and b is not null")
    return d.select(key, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def representative_points(assets: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(key, lat, lon): a point for each geometry: itself, the middle vertex of a line, a place inside a polygon's first ring; unreadable ones have none."""
    from scarpline.operators.raster import representative_point

    kind = assets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            at, out = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                parts = read_geometry(text)
                if parts:
                    part, v = parts[0]
                    ring = v[:-1] if len(v) > 1 and v[0] == v[-1] else v
                    x, y = representative_point(np.array(ring, dtype=float)) if part == RING else v[0] if part == POINT else v[len(v) // 2]
                    at.append(k)
                    out.append((float(y), (float(x) + 180.0) % 360.0 - 180.0 if abs(x) > 180 else float(x)))
            cols = [pa.array([r[c] for r in out], pa.float64()) for c in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=[key, "lat", "lon"])

    return assets.select(key, geometry).where(f"`{geometry}` is not null").mapInArrow(run, f"`{key}` {kind}, lat double, lon double")


def clipped(assets: DataFrame, areas: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """assets (key, area, geometry) with a vertex in the box of their own area (name, bbox), edges included."""
    box = areas.select(F.col("name").alias("area"), F.col("bbox").alias("_box"))
    d = degree_pieces(assets, key, geometry).join(assets.select(key, "area").distinct(), key).join(box, "area")
    at = lambda x, y: F.col(x).between(F.col("_box")[0], F.col("_box")[2]) & F.col(y).between(F.col("_box")[1], F.col("_box")[3])
    return assets.join(d.where(at("lon0", "lat0") | at("lon1", "lat1")).select(key).distinct(), key, "left_semi")


def segments(path: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1, start_m) of a path (key, seq, x, y): its pieces and how far along each begins. A path of one point has none."""
    w = W.partitionBy(key).orderBy("seq")
    s = path.select(key, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    s = s.where("x1 is not null").withColumn("length_m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    upto = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return s.withColumn("start_m", F.coalesce(F.sum("length_m").over(upto), F.lit(0.0)))


def _to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(distance, t) of a point and a segment."""
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / F.when(l2 > 0, l2).otherwise(1.0), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy)), t


def line_reference(segs: DataFrame, pieces: DataFrame, key: str, asset: str, limit_m: float = C.LATERAL_KM * 1000, area: str | None = None) -> DataFrame:
    """(key, asset, lateral_m, along_m): each asset within limit_m of a path, how far beside it and how far along it, the earliest of equal spots.

    segs: segments(). pieces (asset, ax, ay, bx, by): the straight pieces of each asset in the same metres; a point is a piece with
    equal ends. Both sides are put into square buckets of limit_m, segments into all within limit_m of them, and meet by bucket.
    """
    on = [area] if area else []
    size = float(limit_m)
    cell = lambda c: F.floor(c / size).cast("long")
    s = segs.select(key, *on, "x0", "y0", "x1", "y1", "start_m", "length_m")
    s = s.withColumn("_i", F.explode(F.sequence(cell(F.least("x0", "x1") - size), cell(F.greatest("x0", "x1") + size)))).withColumn("_j", F.explode(F.sequence(cell(F.least("y0", "y1") - size), cell(F.greatest("y0", "y1") + size))))
    a = pieces.select(asset, *on, "ax", "ay", "bx", "by")
    a = a.withColumn("_i", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx"))))).withColumn("_j", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))))
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by")}
    seg, piece = (c["x0"], c["y0"], c["x1"], c["y1"]), (c["ax"], c["ay"], c["bx"], c["by"])
    spots = [_to_segment(c["ax"], c["ay"], *seg), _to_segment(c["bx"], c["by"], *seg)]
    spots += [(_to_segment(c["x0"], c["y0"], *piece)[0], F.lit(0.0)), (_to_segment(c["x1"], c["y1"], *piece)[0], F.lit(1.0))]
    dx, dy, ex, ey = c["x1"] - c["x0"], c["y1"] - c["y0"], c["bx"] - c["ax"], c["by"] - c["ay"]
    det = dx * ey - dy * ex
    t = ((c["ax"] - c["x0"]) * ey - (c["ay"] - c["y0"]) * ex) / F.when(det == 0, 1.0).otherwise(det)
    u = ((c["ax"] - c["x0"]) * dy - (c["ay"] - c["y0"]) * dx) / F.when(det == 0, 1.0).otherwise(det)
    crosses = (det != 0) & t.between(0, 1) & u.between(0, 1)
    spots.append((F.when(crosses, 0.0).otherwise(float("inf")), F.when(crosses, t).otherwise(0.0)))
    best = F.array_min(F.array(*[F.struct(F.round(d, 6).alias("d"), (F.col("start_m") + w * F.col("length_m")).alias("along")) for d, w in spots]))
    near = s.join(a, [*on, "_i", "_j"]).select(key, asset, best.alias("b")).where(F.col("b")["d"] <= limit_m)
    return near.groupBy(key, asset).agg(F.min("b").alias("b")).select(key, asset, F.col("b")["d"].alias("lateral_m"), F.col("b")["along"].alias("along_m"))


def exposure(referenced: DataFrame, key: str, asset: str, base: Column, decay_km: float = C.DECAY_KM, rows: int = C.EXPOSURE_ROWS) -> DataFrame:
    """(key, asset, name, type, distance_km, lateral_offset_km, exposure_score): the nearest rows along each path.

    referenced: line_reference() with name, asset_type and what base needs. Of assets with one name and type at one hundredth of a
    kilometre the first along the path stays (then the less lateral, then the smaller id). Rows with equal distance go by name and id.
    """
    d = referenced.withColumn("_at", F.col("along_m") / 1000)
    w = W.partitionBy(key, "name", "asset_type", F.round("_at", 2)).orderBy("_at", "lateral_m", asset)
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    d = d.select(key, asset, "name", F.col("asset_type").alias("type"), F.round("_at", 3).alias("distance_km"), F.round(F.col("lateral_m") / 1000, 3).alias("lateral_offset_km"), P.decayed(base, "_at", decay_km).alias("exposure_score"))
    top = W.partitionBy(key).orderBy("distance_km", "name", asset)
    return d.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= rows).drop("_n")


def rank_assets(exposed: DataFrame, key: str, asset: str) -> DataFrame:
    """exposed with weight, risk_score (4 decimals) and rank within each key, from the highest score down; equal ones by distance, name and id."""
    d = exposed.withColumn("weight", P.asset_weight("type"))
    d = d.withColumn("risk_score", F.round(F.col("exposure_score") * F.col("weight"), 4))
    return d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("risk_score"), "distance_km", "name", asset)))
