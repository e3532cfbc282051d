"""Volume, height and blockage index of a slide, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import constants as C


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _positive(value: Column, given: Column, what: str, strict: bool) -> Column:
    """value where given is above 0; else NULL, or an error in strict mode."""
    bad = F.raise_error(F.concat(F.lit(f"{what} must be above 0, got "), given.cast("string"))) if strict else F.lit(None)
    return F.when(given > 0, value).when(given.isNotNull(), bad.cast("double"))


def volume_m3(area_m2: Column | str, strict: bool = False) -> Column:
    """Scar volume from its area by the power law; NULL (or an error) for an area of 0 or less."""
    a = _col(area_m2)
    return _positive(C.VOLUME_COEFFICIENT * F.pow(a, F.lit(C.VOLUME_EXPONENT)), a, "area_m2", strict)


def dam_height_m(volume: Column | str, relief_m: Column | str | None = None, strict: bool = False) -> Column:
    """Cube root of the volume, at most the local relief where that is known."""
    v = _col(volume)
    h = F.pow(v, F.lit(C.HEIGHT_EXPONENT))
    if relief_m is not None:
        h = F.least(h, _col(relief_m))
    return _positive(h, v, "volume_m3", strict)


def blockage_index(upstream_km2: Column | str, height_m: Column | str, volume: Column | str, strict: bool = False) -> Column:
    """log10 of upstream area times height over volume in millions; NULL (or an error) unless all three are above 0."""
    q, h, v = _col(upstream_km2), _col(height_m), _col(volume)
    return _positive(_positive(_positive(F.log10(q * h / (v / 1e6)), v, "volume_m3", strict), h, "dam_height_m", strict), q, "upstream_area_km2", strict)


def verdict(dbi: Column | str) -> Column:
    """stable below 2.75, uncertain up to 3.08, else breach_risk; NULL for NULL."""
    d = _col(dbi)
    return F.when(d < C.DBI_STABLE_BELOW, "stable").when(d <= C.DBI_UNCERTAIN_UPTO, "uncertain").when(d.isNotNull(), "breach_risk")


def verdict_base(v: Column | str) -> Column:
    """Base score of a verdict; an unknown verdict is an error, NULL stays NULL."""
    v = _col(v)
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    for name, score in C.VERDICT_BASE.items():
        out = out.when(v == name, score)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), v)).cast("double"))


def asset_weight(kind: Column | str) -> Column:
    """Weight of an asset type, 0.5 for any other or NULL."""
    k = _col(kind)
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in C.ASSET_WEIGHTS.items():
        out = out.when(k == name, weight)
    return out.otherwise(C.OTHER_WEIGHT)


def decayed(base: Column | str, distance_km: Column | str, decay_km: float = C.DECAY_KM) -> Column:
    """base falling off exponentially with distance, 4 decimals."""
    return F.round(_col(base) * F.exp(-_col(distance_km) / decay_km), 4)
