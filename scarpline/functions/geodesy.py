"""Distances, projections and pixel grids on WGS84, as Column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import constants as C

# fixed: WGS84 and transverse Mercator
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def equirect_km(lat: Column | str, lon: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Kilometres in the plane around the first point."""
    a, b = _col(lat), _col(lon)
    return F.hypot(_col(lat2) - a, (_col(lon2) - b) * F.cos(F.radians(a))) * C.KM_PER_DEG


def _let(body, **named: Column) -> Column:
    """body of a struct of named values, each evaluated once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in named.items()])), body)[0]


def geodesic_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, rounds: int = 20) -> Column:
    """Metres on the ellipsoid by Vincenty's inverse formula, a fixed number of rounds; for antipodes it may stay inexact."""
    p1, l1, p2, l2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    f, b = FLATTENING, AXIS * (1 - FLATTENING)
    safe = lambda x: F.when(x == 0, 1.0).otherwise(x)

    def sides(k: Column, lam: Column, body) -> Column:
        return _let(
            lambda q: _let(
                body,
                ss=F.hypot(k["c2"] * q["sl"], k["c1"] * k["s2"] - k["s1"] * k["c2"] * q["cl"]), cs=k["s1"] * k["s2"] + k["c1"] * k["c2"] * q["cl"], sl=q["sl"],
            ),
            sl=F.sin(lam), cl=F.cos(lam),
        )

    def bent(k: Column, q: Column, body) -> Column:
        """body of sa, ca2, cm, sig for a triangle of ss, cs, sl."""
        return _let(
            lambda v: _let(body, sa=v["sa"], ca2=v["ca2"], cm=F.when(v["ca2"] == 0, 0.0).otherwise(q["cs"] - 2 * k["s1"] * k["s2"] / safe(v["ca2"])), sig=F.atan2(q["ss"], q["cs"])),
            sa=F.when(q["ss"] == 0, 0.0).otherwise(k["c1"] * k["c2"] * q["sl"] / safe(q["ss"])), ca2=1 - F.when(q["ss"] == 0, 0.0).otherwise(F.pow(k["c1"] * k["c2"] * q["sl"] / safe(q["ss"]), F.lit(2.0))),
        )

    def step(k: Column, lam: Column) -> Column:
        def new(q: Column) -> Column:
            def lam2(v: Column) -> Column:
                return _let(
                    lambda z: k["L"] + (1 - z["c"]) * f * v["sa"] * (v["sig"] + z["c"] * q["ss"] * (v["cm"] + z["c"] * q["cs"] * (-1 + 2 * v["cm"] * v["cm"]))),
                    c=f / 16 * v["ca2"] * (4 + f * (4 - 3 * v["ca2"])),
                )

            return bent(k, q, lam2)

        return sides(k, lam, new)

    def metres(k: Column, lam: Column) -> Column:
        def on(q: Column) -> Column:
            def length(v: Column) -> Column:
                def total(z: Column) -> Column:
                    d = z["B"] * q["ss"] * (v["cm"] + z["B"] / 4 * (q["cs"] * (-1 + 2 * z["cm2"]) - z["B"] / 6 * v["cm"] * (-3 + 4 * q["ss"] * q["ss"]) * (-3 + 4 * z["cm2"])))
                    return b * z["A"] * (v["sig"] - d)

                return _let(
                    lambda w: _let(total, A=1 + w["u"] / 16384 * (4096 + w["u"] * (-768 + w["u"] * (320 - 175 * w["u"]))), B=w["u"] / 1024 * (256 + w["u"] * (-128 + w["u"] * (74 - 47 * w["u"]))), cm2=v["cm"] * v["cm"]),
                    u=v["ca2"] * ((AXIS * AXIS - b * b) / (b * b)),
                )

            return bent(k, q, length)

        return sides(k, lam, on)

    def between(v: Column) -> Column:
        """Equal points have no direction and no distance."""
        apart = _let(
            lambda k: metres(k, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["L"], lambda lam, _: step(k, lam))),
            s1=F.sin(v["u1"]), c1=F.cos(v["u1"]), s2=F.sin(v["u2"]), c2=F.cos(v["u2"]), L=v["L"],
        )
        return F.when((v["u1"] == v["u2"]) & (v["L"] == 0), 0.0).otherwise(apart)

    return _let(between, u1=F.atan((1 - f) * F.tan(p1)), u2=F.atan((1 - f) * F.tan(p2)), L=l2 - l1)


# Krueger series in the third flattening, order 6 (Karney 2011)
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
_ECC = sqrt(FLATTENING * (2 - FLATTENING))


def utm_zone(crs: Column | str) -> Column:
    """(central meridian, southern) of EPSG:326xx or EPSG:327xx; NULL for anything else."""
    m = F.regexp_extract(F.coalesce(_col(crs), F.lit("")), r"^(?i:epsg):32([67])(\d\d)$", 0)
    zone = F.try_element_at(F.split(m, "32[67]"), F.lit(2)).try_cast("int")
    ok = (m != "") & zone.between(1, 60)
    return F.when(ok, F.struct((zone * 6 - 183).cast("double").alias("meridian"), m.contains(":327").alias("south")))


def _series(a: tuple[float, ...], xi: Column, eta: Column) -> tuple[Column, Column]:
    """The corrections to both coordinates."""
    terms = [(c, 2.0 * (k + 1)) for k, c in enumerate(a)]
    return sum(c * F.sin(m * xi) * F.cosh(m * eta) for c, m in terms), sum(c * F.cos(m * xi) * F.sinh(m * eta) for c, m in terms)


def to_utm(lat: Column | str, lon: Column | str, crs: Column | str) -> Column:
    """(x, y) in metres in the UTM zone that crs names; NULL for other systems."""

    def metres(v: Column) -> Column:
        more = _series(_FORWARD, v["xi"], v["eta"])
        x = FALSE_EAST + SCALE * _RECTIFYING * (v["eta"] + more[1])
        y = F.when(v["south"], FALSE_NORTH_SOUTH).otherwise(0.0) + SCALE * _RECTIFYING * (v["xi"] + more[0])
        return F.struct(x.alias("x"), y.alias("y"))

    def plane(v: Column) -> Column:
        return _let(metres, xi=F.atan2(v["t"], F.cos(v["lam"])), eta=F.asinh(F.sin(v["lam"]) / F.hypot(v["t"], F.cos(v["lam"]))), south=v["south"])

    def conformal(v: Column) -> Column:
        return _let(plane, t=F.sinh(F.atanh(v["s"]) - _ECC * F.atanh(_ECC * v["s"])), lam=F.radians(v["lon"] - v["zone"]["meridian"]), south=v["zone"]["south"])

    return _let(lambda v: F.when(v["zone"].isNotNull(), conformal(v)), s=F.sin(F.radians(_col(lat))), lon=_col(lon), zone=utm_zone(crs))


def from_utm(x: Column | str, y: Column | str, crs: Column | str) -> Column:
    """(lat, lon) of UTM metres; EPSG:4326 passes x, y through as lon, lat; NULL for other systems."""

    def latitude(v: Column) -> Column:
        s = F.tanh(v["psi"])
        for _ in range(6):
            s = F.tanh(v["psi"] + _ECC * F.atanh(_ECC * s))
        return F.struct(F.degrees(F.asin(s)).alias("lat"), (v["meridian"] + v["lon"]).alias("lon"))

    def sphere(v: Column) -> Column:
        psi = F.asinh(F.tan(F.asin(F.sin(v["xi"]) / F.cosh(v["eta"]))))
        return _let(latitude, psi=psi, lon=F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))), meridian=v["meridian"])

    def plane(v: Column) -> Column:
        less = _series(_INVERSE, v["xi"], v["eta"])
        return _let(sphere, xi=v["xi"] - less[0], eta=v["eta"] - less[1], meridian=v["meridian"])

    def scaled(v: Column) -> Column:
        z = v["zone"]
        return _let(plane, xi=(v["y"] - F.when(z["south"], FALSE_NORTH_SOUTH).otherwise(0.0)) / (SCALE * _RECTIFYING), eta=(v["x"] - FALSE_EAST) / (SCALE * _RECTIFYING), meridian=z["meridian"])

    def place(v: Column) -> Column:
        same = F.struct(v["y"].alias("lat"), v["x"].alias("lon"))
        return F.when(v["plain"], same).when(v["zone"].isNotNull(), scaled(v))

    return _let(place, x=_col(x).cast("double"), y=_col(y).cast("double"), zone=utm_zone(crs), plain=F.upper(_col(crs)) == "EPSG:4326")


def pixel_centre(t: Column | str, row: Column | str, col: Column | str) -> Column:
    """(x, y) of a pixel's centre; t: the six numbers a..f of x = a*col + b*row + c, y = d*col + e*row + f."""
    t, r, c = _col(t), _col(row) + 0.5, _col(col) + 0.5
    return F.struct((t[0] * c + t[1] * r + t[2]).alias("x"), (t[3] * c + t[4] * r + t[5]).alias("y"))


def pixel_of(t: Column | str, x: Column | str, y: Column | str) -> Column:
    """(row, col) of the pixel that holds a point, for grids without rotation."""
    t = _col(t)
    return F.struct(F.floor((_col(y) - t[5]) / t[4]).cast("int").alias("row"), F.floor((_col(x) - t[2]) / t[0]).cast("int").alias("col"))


def grid_from_centres(x0: Column | str, y0: Column | str, step_x: Column | str, step_y: Column | str) -> Column:
    """The six numbers of a grid given by the centre of its first cell and its steps (downwards positive)."""
    sx, sy = _col(step_x), _col(step_y)
    zero = F.lit(0.0)
    return F.array(sx, zero, _col(x0) - sx / 2, zero, -sy, _col(y0) + sy / 2)


def cell_size(t: Column | str, height: Column | str) -> Column:
    """(x_m, y_m, area_km2) of a cell of a grid in degrees, at its middle latitude."""
    t, h = _col(t), _col(height)
    middle = t[5] + t[4] * h / 2
    y = F.abs(t[4]) * C.METRES_PER_DEG
    x = F.abs(t[0]) * C.METRES_PER_DEG * F.cos(F.radians(middle))
    return F.struct(x.alias("x_m"), y.alias("y_m"), (x * y / 1e6).alias("area_km2"))


def ground_resolution(path: Column | str, t: Column | str, width: Column | str, height: Column | str, crs: Column | str, fallback: Column | float) -> Column:
    """(gsd, source): the geodesic diagonal of the image over its diagonal in pixels and geotiff_crs, or (fallback, fallback) for anything that is not a georeferenced TIFF."""
    t, w, h = _col(t), _col(width).cast("double"), _col(height).cast("double")
    fall = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    none = F.struct(fall.alias("gsd"), F.lit("fallback").alias("source"))
    known = lambda v: F.when(v["gsd"] > 0, F.struct(v["gsd"].alias("gsd"), F.lit("geotiff_crs").alias("source"))).otherwise(none)
    measured = _let(
        lambda v: _let(known, gsd=geodesic_m(v["a"]["lat"], v["a"]["lon"], v["z"]["lat"], v["z"]["lon"]) / F.sqrt(v["n"])),
        a=from_utm(t[2], t[5], crs), z=from_utm(t[0] * w + t[1] * h + t[2], t[3] * w + t[4] * h + t[5], crs), n=w * w + h * h,
    )
    return F.coalesce(F.when(is_tiff(path), measured), none)


def image_centre(path: Column | str, t: Column | str, width: Column | str, height: Column | str, crs: Column | str) -> Column:
    """(lat, lon) of the image's centre; NULL unless it is a georeferenced TIFF."""
    t, w, h = _col(t), _col(width).cast("double") / 2, _col(height).cast("double") / 2
    return F.when(is_tiff(path), from_utm(t[0] * w + t[1] * h + t[2], t[3] * w + t[4] * h + t[5], crs))


def is_tiff(path: Column | str) -> Column:
    return F.lower(_col(path)).rlike(r"\.tiff?$")
