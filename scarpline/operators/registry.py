"""Study areas: listing, lookup, and which area a point lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions.geodesy import geodesic_m

#: More areas than this are joined by cells of one degree instead of being sent to every task.
SENT_AREAS = 5_000
DEFAULT_PBF = "data/raw/osm/extract.osm.pbf"


def list_areas(areas: DataFrame) -> DataFrame:
    return areas.select("name").orderBy("name")


def area_config(areas: DataFrame, name: str) -> dict:
    """The settings of one area; KeyError for an unknown name."""
    row = areas.where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return row.asDict()


def pbf_path(override: Column, default: str = DEFAULT_PBF) -> Column:
    """The area's own extract; a NULL or empty one falls back to the shared default."""
    return F.coalesce(F.nullif(override, F.lit("")), F.lit(default))


def area_paths(base: Column) -> Column:
    """The derived paths of an area folder, as a map."""
    at = {"base": "", "config": "/config.json", "dem": "/dem_glo30.tif", "processed": "/processed", "channel_mask": "/processed/channel_mask.tif", "drainage_graph": "/processed/drainage_graph", "roads": "/processed/roads.geojson", "pois": "/processed/pois.geojson", "validation": "/validation"}
    return F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.concat(base, F.lit(v)))])


def inside(lat: Column, lon: Column, box: Column) -> Column:
    """Whether a point lies in (lon_min, lat_min, lon_max, lat_max), edges included; no box spans the 180th meridian here."""
    return (lon >= box[0]) & (lon <= box[2]) & (lat >= box[1]) & (lat <= box[3])


def locate(points: DataFrame, areas: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with the column area: the alphabetically first area whose box holds the point, NULL where none does or a coordinate is NULL.

    Points repeat nothing: one row out for each row in. A large table of areas is met through cells of one degree.
    """
    small = areas.limit(SENT_AREAS + 1).count() <= SENT_AREAS
    a = areas.select(F.col("name").alias("_name"), F.col("bbox").alias("_box"))
    if small:
        near = F.broadcast(a)  # at most SENT_AREAS rows
        first = points.select(key, lat, lon).join(near, inside(F.col(lat), F.col(lon), F.col("_box")))
    else:
        i, j = F.floor(lat).cast("int"), F.floor(lon).cast("int")
        cells = a.where("_box[0] <= _box[2] and _box[1] <= _box[3]").withColumn("_i", F.explode(F.sequence(F.floor(F.col("_box")[1]).cast("int"), F.floor(F.col("_box")[3]).cast("int"))))
        cells = cells.withColumn("_j", F.explode(F.sequence(F.floor(F.col("_box")[0]).cast("int"), F.floor(F.col("_box")[2]).cast("int"))))
        first = points.select(key, lat, lon, i.alias("_i"), j.alias("_j")).join(cells, ["_i", "_j"]).where(inside(F.col(lat), F.col(lon), F.col("_box")))
    found = first.groupBy(key).agg(F.min("_name").alias("area"))
    return points.join(found, key, "left")


def location_state(embedded_lat: Column, embedded_lon: Column, embedded_area: Column, region: Column, distance_km: Column) -> Column:
    """none (a coordinate or both NULL), outside (also out of range), region_mismatch, point_mismatch (strictly more than 1 km) or confirmed."""
    return (
        F.when(embedded_lat.isNull() | embedded_lon.isNull(), "none")
        .when(embedded_area.isNull(), "outside")
        .when(embedded_area != region, "region_mismatch")
        .when(distance_km > C.POINT_MISMATCH_KM, "point_mismatch")
        .otherwise("confirmed")
    )


def crosscheck(uploads: DataFrame, areas: DataFrame, key: str, distance_km: Column | None = None) -> DataFrame:
    """uploads (key, embedded_lat, embedded_lon, region, lat, lon) with embedded_area, distance_km and state; no distance is given from or to a latitude beyond the poles."""
    d = distance_km if distance_km is not None else F.when(F.greatest(F.abs("embedded_lat"), F.abs("lat")) <= 90, geodesic_m("embedded_lat", "embedded_lon", "lat", "lon") / 1000)
    located = locate(uploads, areas, key, "embedded_lat", "embedded_lon").withColumnRenamed("area", "embedded_area")
    located = located.withColumn("distance_km", d)
    return located.withColumn("state", location_state(F.col("embedded_lat"), F.col("embedded_lon"), F.col("embedded_area"), F.col("region"), F.col("distance_km")))


def clamped_input(lat: Column, lon: Column, box: Column) -> Column:
    """(lat, lon, valid): coordinates at 4 decimals and whether they lie in the area's box."""
    return F.struct(F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), F.coalesce(inside(lat, lon, box), F.lit(False)).alias("valid"))
