"""Band arithmetic, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import constants as C


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ndwi(green: Column | str, nir: Column | str) -> Column:
    """(green - nir) / (green + nir) in doubles; 0.0, not NULL, where the sum is 0."""
    g, n = _col(green).cast("double"), _col(nir).cast("double")
    return F.when(g.isNotNull() & n.isNotNull(), F.coalesce(F.try_divide(g - n, g + n), F.lit(0.0)))


def heat(value: Column | str) -> Column:
    """(r, g, b) from blue at 1 to red at -1, clipped."""
    t = (F.least(F.greatest(_col(value), F.lit(-1.0)), F.lit(1.0)) + 1) / 2
    return F.struct(F.floor((1 - t) * 255).cast("int").alias("r"), F.lit(0).alias("g"), F.floor(t * 255).cast("int").alias("b"))


def reflectance(dn: Column | str) -> Column:
    """Surface reflectance of a scaled digital number."""
    return _col(dn) * C.REFLECTANCE_SCALE + C.REFLECTANCE_OFFSET


def three_bands(bands: Column | str) -> Column:
    """The first three bands, repeated in turn where there are fewer."""
    b = _col(bands)
    return F.slice(F.concat(b, b, b), 1, 3)


def reversed_bands(bands: Column | str) -> Column:
    """Bands in the opposite order, as detectors that take blue first want them."""
    return F.reverse(_col(bands))


def stretched(value: Column | str, low: Column | str, high: Column | str, clip_first: bool = False) -> Column:
    """A byte between the two percentiles; clip_first clips to 0..1 before scaling, to the same effect save for rounding."""
    v, lo, hi = _col(value), _col(low), _col(high)
    x = (v - lo) / (hi - lo + C.STRETCH_EPSILON)
    if clip_first:
        return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return F.floor(F.least(F.greatest(x * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def binary_mask(value: Column | str, raw: bool = False) -> Column:
    """Foreground of a mask: above 127, or above 0 for a raw one."""
    return _col(value) > (0 if raw else C.MASK_ABOVE)


def normalised_mask(value: Column | str) -> Column:
    """A raw mask value as 0 or 255."""
    return F.when(_col(value) > 0, 255).when(_col(value).isNotNull(), 0)
