"""Names, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import constants as C


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_name(name: Column | str, fallback: Column | str) -> Column:
    """The name, or 'unnamed <fallback>' where it is NULL."""
    return F.coalesce(_col(name), F.concat(F.lit("unnamed "), _col(fallback)))


def poi_kind(amenity: Column | str, place: Column | str) -> Column:
    """school before health before settlement before other."""
    a, p = _col(amenity), _col(place)
    return F.when(a == "school", "school").when(a.isin(*C.HEALTH_AMENITIES), "health").when(p.isin(*C.PLACES), "settlement").otherwise("other")


def road_kind(bridge: Column | str) -> Column:
    """bridge where the tag is there, whatever its value; else road."""
    return F.when(_col(bridge).isNotNull(), "bridge").otherwise("road")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def after_first_underscore(name: Column | str) -> Column:
    """What pairs image_X with mask_X: everything after the first underscore; NULL without one."""
    n = _col(name)
    return F.when(n.contains("_"), F.regexp_extract(n, r"^[^_]*_(.*)$", 1))


def without_affix(name: Column | str, prefix: str = "", suffix: str = "") -> Column:
    """The name without a fixed prefix and suffix, where it has them."""
    import re

    return F.regexp_replace(F.regexp_replace(_col(name), f"^{re.escape(prefix)}", ""), f"{re.escape(suffix)}$", "")


def part_from_end(path: Column | str, k: int) -> Column:
    """The k-th part of a path, counted from its end; NULL if it is shorter."""
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-k))


def scar_id(stem_: Column | str, index: Column | str) -> Column:
    return F.concat(_col(stem_), F.lit("-scar"), _col(index).cast("string"))


def literal_list(text: Column | str) -> Column:
    """The numbers of a list or tuple written as program text, as doubles; NULL for anything else."""
    t = F.trim(_col(text))
    inner = F.regexp_replace(F.translate(t, "()", "[]"), r",\s*\]", "]")
    return F.when(t.rlike(r"^[\[(][-+0-9.eE,\s]*[\])]$"), F.from_json(inner, "array<double>"))


def percent(part: Column, whole: Column) -> Column:
    """'part/whole (p%)' with one decimal; '0/0 (0.0%)' for nothing of nothing."""
    share = F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)
    return F.format_string("%d/%d (%.1f%%)", part.cast("long"), whole.cast("long"), share)
