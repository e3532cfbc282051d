"""Reading geometries written as WKT or GeoJSON."""

from __future__ import annotations

import json
import math
import re

#: A part is a kind (0 point, 1 line, 2 polygon ring) and its vertices; rings of one polygon follow each other.
POINT, LINE, RING = 0, 1, 2

_WKT = re.compile(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", re.I | re.S)
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_VERTEX = rf"\s*{_NUMBER}(?:\s+{_NUMBER}){{1,3}}\s*"
_RUN = re.compile(rf"\(({_VERTEX}(?:,{_VERTEX})*)\)")
_REST = re.compile(r"[\s,()]*$")


def _vertices(run: str) -> list[tuple[float, float]]:
    out = []
    for v in run.split(","):
        x = v.split()
        out.append((float(x[0]), float(x[1])))
    return out


def _pairs(coordinates: list) -> list[tuple[float, float]]:
    return [(float(c[0]), float(c[1])) for c in coordinates]


def _parts(text: str) -> list[tuple[int, list[tuple[float, float]]]]:
    if text.lstrip()[:1] == "{":
        g = json.loads(text)
        kind, c = str(g["type"]).lower(), g["coordinates"]
        if kind == "point":
            return [(POINT, _pairs([c]))]
        if kind == "multipoint":
            return [(POINT, [p]) for p in _pairs(c)]
        if kind == "linestring":
            return [(LINE, _pairs(c))]
        if kind == "multilinestring":
            return [(LINE, _pairs(line)) for line in c]
        if kind == "polygon":
            return [(RING, _pairs(ring)) for ring in c]
        if kind == "multipolygon":
            return [(RING, _pairs(ring)) for polygon in c for ring in polygon]
        return []
    m = _WKT.match(text)
    if not m:
        return []
    many, kind, body = bool(m[1]), m[2].upper(), m[3]
    if many and kind == "POINT":
        body = "(" + body.replace("(", "").replace(")", "") + ")"
    runs = _RUN.findall(body)
    if not runs or not _REST.match(_RUN.sub("", body)):
        return []
    if kind == "POINT":
        return [(POINT, [p]) for run in runs for p in _vertices(run)]
    return [(LINE if kind == "LINESTRING" else RING, _vertices(run)) for run in runs]


def read_geometry(text: str | None) -> list[tuple[int, list[tuple[float, float]]]]:
    """The parts of a geometry, longitude before latitude, with longitudes unwrapped so that each part goes the short way round.

    WKT in any case, with free blanks, further ordinates or an SRID, and GeoJSON geometries; single and multiple points, lines
    and polygons. Anything NULL, empty, unreadable, not finite or without coordinates has no parts.
    """
    if not text:
        return []
    try:
        parts = [(k, v) for k, v in _parts(text) if v]
    except (ValueError, TypeError, KeyError, IndexError):
        return []
    start = None
    out = []
    for k, v in parts:
        w, at = [], start
        for x, y in v:
            if not (math.isfinite(x) and math.isfinite(y)):
                return []
            if at is not None:
                x -= 360.0 * round((x - at) / 360.0)
            at = x
            if start is None:
                start = x
            w.append((x, y))
        out.append((k, w))
    return out
