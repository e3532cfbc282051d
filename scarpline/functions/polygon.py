"""Polygons as arrays of (x, y) structs, and as flat normalised arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import constants as C

POLYGON = "array<struct<x:double,y:double>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _next(p: Column) -> Column:
    """The polygon turned by one corner."""
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def area_px(polygon: Column | str) -> Column:
    """Shoelace area; 0 for fewer than three corners, NULL for NULL."""
    p = _col(polygon)
    cross = F.zip_with(p, _next(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(p) < 3, 0.0).when(p.isNotNull(), F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def area_m2(polygon: Column | str, gsd: Column | float | None = None) -> Column:
    """Area in square metres; a NULL or missing pixel size counts as 10 m."""
    g = F.coalesce(gsd if isinstance(gsd, Column) else F.lit(gsd).cast("double"), F.lit(C.DEFAULT_GSD_M_PER_PX))
    return area_px(polygon) * g * g


def perimeter(polygon: Column | str) -> Column:
    """Length of the closed ring."""
    p = _col(polygon)
    sides = F.zip_with(p, _next(p), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)


def stub_detection(height: Column | str, width: Column | str) -> Column:
    """The deterministic detection: a hexagon placed by the image size alone."""
    h, w = _col(height).cast("double"), _col(width).cast("double")
    cx, cy, rx, ry = w * C.STUB_CENTRE[0], h * C.STUB_CENTRE[1], w * C.STUB_RADIUS[0], h * C.STUB_RADIUS[1]
    corners = [F.struct(F.round(cx + rx * dx, 1).alias("x"), F.round(cy + ry * dy, 1).alias("y")) for dx, dy in C.STUB_CORNERS]
    return F.array(F.struct(F.array(*corners).alias("mask_polygon"), F.lit(C.STUB_CONFIDENCE).alias("confidence"), F.lit("landslide").alias("class")))


def to_flat(polygon: Column | str, width: Column | str, height: Column | str) -> Column:
    """[x1, y1, ...] in fractions of the image, 6 decimals."""
    w, h = _col(width), _col(height)
    return F.flatten(F.transform(_col(polygon), lambda c: F.array(F.round(c["x"] / w, 6), F.round(c["y"] / h, 6))))


def from_flat(flat: Column | str, width: Column | str, height: Column | str) -> Column:
    """Corners in pixels of a flat normalised array."""
    f, w, h = _col(flat), _col(width), _col(height)
    pairs = F.floor(F.size(f) / 2).cast("int")
    at = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.struct((F.get(f, k * 2) * w).alias("x"), (F.get(f, k * 2 + 1) * h).alias("y")))


def label_line(flat: Column | str, label: Column | int = 0) -> Column:
    """A label line: the class and the coordinates with 6 decimals."""
    k = label if isinstance(label, Column) else F.lit(label)
    return F.concat_ws(" ", k.cast("string"), F.array_join(F.transform(_col(flat), lambda v: F.format_string("%.6f", v)), " "))


def parse_label(line: Column | str) -> Column:
    """(label, flat) of a label line; NULL for a blank or NULL line."""
    parts = F.split(F.trim(_col(line)), r"\s+")
    flat = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.cast("double"))
    return F.when(F.trim(_col(line)) != "", F.struct(parts[0].cast("int").alias("label"), flat.alias("flat")))
