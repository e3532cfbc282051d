"""Rasters as pixel tables and as one row a chip."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions import bands as B


def percentile_stretch(pixels: DataFrame, keys: list[str], value: str, finite_only: bool = False) -> DataFrame:
    """pixels with stretched: bytes between the 2nd and 98th percentile (linear) of each chip and band.

    finite_only leaves NaN and infinite values out of the percentiles; a NaN is stretched to 0. NULLs stay NULL.
    """
    v = F.col(value)
    use = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) if finite_only else v
    limits = pixels.groupBy(*keys).agg(F.percentile(use, F.array(*map(F.lit, C.STRETCH))).alias("_p"))
    joined = pixels.join(limits, keys)
    out = B.stretched(F.when(F.isnan(v), F.col("_p")[0]).otherwise(v), F.col("_p")[0], F.col("_p")[1], finite_only)
    return joined.withColumn("stretched", out).drop("_p")


def chip_stats(pixels: DataFrame, key: str, green: str = "green", nir: str = "nir", threshold: float = C.NDWI_THRESHOLD) -> DataFrame:
    """(key, pixels, water_pixels, water_fraction, mean_ndwi) of each chip; water is strictly above the threshold."""
    d = pixels.select(key, B.ndwi(green, nir).alias("w"))
    return d.groupBy(key).agg(
        F.count("w").alias("pixels"),
        F.count_if(F.col("w") > threshold).alias("water_pixels"),
        (F.count_if(F.col("w") > threshold) / F.count("w")).alias("water_fraction"),
        F.avg("w").alias("mean_ndwi"),
    )


def mask_audit(masks: DataFrame, key: str, height: int | Column, width: int | Column, value: str = "value") -> DataFrame:
    """(key, positive_pixels, foreground_frac, touches_border) of masks (key, row, col, value)."""
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    fg = B.binary_mask(value)
    edge = (F.col("row") == 0) | (F.col("row") == h - 1) | (F.col("col") == 0) | (F.col("col") == w - 1)
    return masks.groupBy(key).agg(
        F.count_if(fg).alias("positive_pixels"),
        (F.count_if(fg) / F.first(h * w)).alias("foreground_frac"),
        F.coalesce(F.bool_or(fg & edge), F.lit(False)).alias("touches_border"),
    )


def flagged_ratio(audit: DataFrame) -> DataFrame:
    """(flagged, total, ratio) of chips whose foreground touches the border."""
    return audit.agg(F.count_if("touches_border").alias("flagged"), F.count(F.lit(1)).alias("total"), (F.count_if("touches_border") / F.count(F.lit(1))).alias("ratio"))


def components(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """(labels, n): connected parts of a mask, 4-connected unless diagonal; labels from 1 in reading order. Runs of rows, joined by union."""
    h, w = mask.shape
    run_row, run_from, run_to = [], [], []
    for r in range(h):
        d = np.diff(np.r_[0, mask[r].astype(np.int8), 0])
        a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        run_row += [r] * len(a)
        run_from += a.tolist()
        run_to += b.tolist()
    up = list(range(len(run_row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by_row: dict[int, list[int]] = {}
    for i, r in enumerate(run_row):
        by_row.setdefault(r, []).append(i)
    reach = int(diagonal)
    for r, own in by_row.items():
        above, k = by_row.get(r - 1, []), 0
        for i in own:
            while k < len(above) and run_to[above[k]] + reach <= run_from[i]:
                k += 1
            m = k
            while m < len(above) and run_from[above[m]] < run_to[i] + reach:
                a, b = root(above[m]), root(i)
                if a != b:
                    up[max(a, b)] = min(a, b)
                m += 1
    label, names = np.zeros((h, w), np.int32), {}
    for i in range(len(run_row)):
        label[run_row[i], run_from[i] : run_to[i]] = names.setdefault(root(i), len(names) + 1)
    return label, len(names)


#: Fixed: the eight neighbours, clockwise from east (row, column).
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def borders(mask: np.ndarray, outer_only: bool = False) -> list[np.ndarray]:
    """Closed borders of the 8-connected foreground as (x, y) pixels, outer ones and, unless outer_only, those around holes.

    A border is followed from pixel to pixel by the right hand, starting where foreground follows background in reading order (outer)
    or background follows foreground (hole), as in Suzuki and Abe (1985).
    """
    f = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), np.int32)
    f[1:-1, 1:-1] = mask
    out, number = [], 1
    for r in range(1, f.shape[0] - 1):
        for c in np.flatnonzero(f[r]):
            outer = f[r, c] == 1 and f[r, c - 1] == 0
            hole = not outer and f[r, c] >= 1 and f[r, c + 1] == 0
            if not (outer or hole):
                continue
            number += 1
            k = 4 if outer else 0
            first = next((d % 8 for d in range(k, k + 8) if f[r + _AROUND[d % 8][0], c + _AROUND[d % 8][1]]), None)
            if first is None:
                f[r, c] = -number
                ring = [(c - 1, r - 1)]
            else:
                start = (r, c)
                end = (r + _AROUND[first][0], c + _AROUND[first][1])
                back, at, ring = first, start, []
                while True:
                    east_zero = False
                    for d in range(back - 1, back - 9, -1):
                        y, x = at[0] + _AROUND[d % 8][0], at[1] + _AROUND[d % 8][1]
                        if f[y, x]:
                            break
                        east_zero |= d % 8 == 0
                    if east_zero:
                        f[at] = -number
                    elif f[at] == 1:
                        f[at] = number
                    ring.append((at[1] - 1, at[0] - 1))
                    if (y, x) == start and at == end:
                        break
                    back, at = (d + 4) % 8, (y, x)
            if outer or not outer_only:
                out.append(np.array(ring, dtype=float))
    if outer_only:
        label, _ = components(mask, True)
        seen: set[int] = set()
        kept = []
        for ring in out:
            k = int(label[int(ring[0][1]), int(ring[0][0])])
            if k not in seen:
                seen.add(k)
                kept.append(ring)
        return kept
    return out


def corners_only(ring: np.ndarray) -> np.ndarray:
    """A border without the pixels in the middle of straight steps."""
    if len(ring) < 3:
        return ring
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    return ring[(before != after).any(1)]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def ring_length(ring: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum())


def simplified(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas and Peucker on a closed ring: cut at its first corner and at the one farthest from it."""
    if len(ring) < 3:
        return ring

    def thin(a: int, b: int, keep: np.ndarray) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            p, q = closed[a], closed[b]
            mid, d = closed[a + 1 : b], q - p
            length = np.hypot(*d)
            far = np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / length if length else np.hypot(*(mid - p).T)
            k = int(np.argmax(far))
            if far[k] > epsilon:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]

    closed = np.vstack([ring, ring[:1]])
    middle = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep = np.zeros(len(closed), bool)
    keep[[0, middle]] = True
    thin(0, middle, keep)
    thin(middle, len(ring), keep)
    return closed[:-1][keep[:-1]]


def filled(ring: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The pixels that a ring surrounds, those on it included: what lies outside is reached from the frame without crossing it."""
    wall = np.zeros((shape[0] + 2, shape[1] + 2), bool)
    closed = np.vstack([ring, ring[:1]])
    for (x0, y0), (x1, y1) in zip(closed, closed[1:]):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        wall[np.rint(np.linspace(y0, y1, n)).astype(int) + 1, np.rint(np.linspace(x0, x1, n)).astype(int) + 1] = True
    label, _ = components(~wall)
    return (label != label[0, 0])[1:-1, 1:-1]


def polygons_of(mask: np.ndarray, value: np.ndarray | None = None, outer_only: bool = False, smallest: float = C.MIN_CONTOUR_AREA_PX) -> list[dict]:
    """Simplified borders of at least the smallest area; with value, the mean of it inside each filled border as its confidence, within 0..1."""
    out = []
    for ring in borders(mask, outer_only):
        ring = corners_only(ring)
        if ring_area(ring) < smallest:
            continue
        s = simplified(ring, C.APPROX_FRACTION * ring_length(ring))
        if len(s) < 3:
            s = ring
        if len(s) < 3:
            continue
        sure = None if value is None else round(float(min(1.0, max(0.0, value[filled(ring, mask.shape)].mean()))), 4)
        out.append({"mask_polygon": [{"x": round(float(x), 1), "y": round(float(y), 1)} for x, y in s], "confidence": sure, "class": "flood"})
    return out


DETECTION = "struct<mask_polygon:array<struct<x:double,y:double>>,confidence:double,class:string>"
_CORNERS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_DETECTIONS = pa.list_(pa.struct([("mask_polygon", _CORNERS), ("confidence", pa.float64()), ("class", pa.string())]))


def per_chip(pixels: DataFrame, key: str, value: Column, name: str, kind: str, arrow: pa.DataType, of: Callable[[np.ndarray], object]) -> DataFrame:
    """(key, name): of(grid) for each chip of pixels (key, row, col); a chip is packed into one row in the JVM, and Python gets batches of chips."""
    chips = pixels.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value.cast("double").alias("v"))
    chips = chips.where("row >= 0 and col >= 0").groupBy(key).agg(F.collect_list(F.struct("row", "col", F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))]
            row, col, v = (f.to_numpy(zero_copy_only=False) for f in b.column(1).flatten().flatten())
            out = []
            for a, z in zip(ends, ends[1:]):
                r, c = row[a:z], col[a:z]
                g = np.zeros((int(r.max()) + 1, int(c.max()) + 1))
                g[r, c] = v[a:z]
                out.append(of(g))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow)], names=[key, name])

    return chips.mapInArrow(run, f"`{key}` {pixels.schema[key].dataType.simpleString()}, `{name}` {kind}")


def component_counts(masks: DataFrame, key: str, value: str = "value", diagonal: bool = False) -> DataFrame:
    """(key, n_components) of masks (key, row, col, value); a NULL value is background."""
    return per_chip(masks, key, F.col(value), "n_components", "int", pa.int32(), lambda g: components(g > C.MASK_ABOVE, diagonal)[1])


def water_polygons(pixels: DataFrame, key: str, threshold: float = C.NDWI_THRESHOLD, smallest: float = C.MIN_CONTOUR_AREA_PX) -> DataFrame:
    """(key, detections) of pixels (key, row, col, green, nir): borders of the water and of holes in it, with the mean index inside."""
    return per_chip(pixels, key, B.ndwi("green", "nir"), "detections", f"array<{DETECTION}>", _DETECTIONS, lambda g: polygons_of(g > threshold, g, smallest=smallest))


def mask_polygons(masks: DataFrame, key: str, value: str = "value", outer_only: bool = False, smallest: float = C.MIN_CONTOUR_AREA_PX) -> DataFrame:
    """(key, polygons) of masks (key, row, col, value); outer_only leaves the borders of holes out."""
    of = lambda g: [p["mask_polygon"] for p in polygons_of(g > C.MASK_ABOVE, None, outer_only, smallest)]
    return per_chip(masks, key, F.col(value), "polygons", "array<array<struct<x:double,y:double>>>", pa.list_(_CORNERS), of)


def inside_even_odd(xs: np.ndarray, ys: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points lie inside a ring."""
    hit = np.zeros(np.broadcast(xs, ys).shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0)):
        if y0 != y1:
            hit ^= ((y0 > ys) != (y1 > ys)) & (xs < x0 + (ys - y0) / (y1 - y0) * (x1 - x0))
    return hit


def overlap_areas(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float]:
    """Areas of the intersection and of the union of two unions of polygons (each polygon by the even-odd rule), exactly.

    Every vertex and every crossing of two edges begins a slab; inside a slab edges only follow each other, so that what lies between
    two neighbours is a trapezoid with one state.
    """
    rings = [(r, k) for k, s in enumerate((a, b)) for r in s if len(r) >= 3]
    e = [(*p, *q, n, k) for n, (r, k) in enumerate(rings) for p, q in zip(r, np.roll(r, -1, 0)) if p[1] != q[1]]
    if not e:
        return 0.0, 0.0
    e = np.array(e, dtype=float)
    swap = e[:, 1] > e[:, 3]
    e[swap] = e[swap][:, [2, 3, 0, 1, 4, 5]]
    x0, y0, x1, y1 = e[:, :4].T
    dx, dy = x1 - x0, y1 - y0
    i, j = np.triu_indices(len(e), 1)
    det = dx[i] * dy[j] - dy[i] * dx[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x0[j] - x0[i]) * dy[j] - (y0[j] - y0[i]) * dx[j]) / det
        u = ((x0[j] - x0[i]) * dy[i] - (y0[j] - y0[i]) * dx[i]) / det
        crosses = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    ys = np.unique(np.r_[y0, y1, (y0[i] + t * dy[i])[crosses]])
    both = either = 0.0
    for lo, hi in zip(ys, ys[1:]):
        middle = (lo + hi) / 2
        on = np.flatnonzero((y0 <= middle) & (y1 > middle))
        x = x0[on] + (middle - y0[on]) / dy[on] * dx[on]
        order = np.argsort(x, kind="stable")
        inside, count = set(), [0, 0]
        for k, m in zip(order, order[1:]):
            n, s = int(e[on[k], 4]), int(e[on[k], 5])
            count[s] += -1 if n in inside else 1
            inside ^= {n}
            part = (x[m] - x[k]) * (hi - lo)
            either += part if count[0] or count[1] else 0.0
            both += part if count[0] and count[1] else 0.0
    return both, either


def iou(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Intersection over union of two unions of polygons; 0.0 if either is empty or without area."""
    if not any(len(p) >= 3 for p in a) or not any(len(p) >= 3 for p in b):
        return 0.0
    both, either = overlap_areas(a, b)
    return float(both / either) if either else 0.0


def polygon_iou(a: Column | str, b: Column | str) -> Column:
    """IoU of two arrays of polygons; NULL arrays count as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rings = lambda s: [np.array([(c["x"], c["y"]) for c in p], dtype=float).reshape(-1, 2) for p in s] if s is not None else []
        for x, y in batches:
            yield pd.Series([iou(rings(p), rings(q)) for p, q in zip(x, y)])

    return run(a, b)


def representative_point(ring: np.ndarray) -> tuple[float, float]:
    """A point inside a polygon: its centroid, or the middle of the widest span on the line through the middle of its height."""
    if len(ring) < 3:
        return tuple(ring.mean(0))
    x, y = ring[:, 0], ring[:, 1]
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if cross.sum():
        c = np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (3 * cross.sum())
        if inside_even_odd(c[0:1], c[1:2], ring)[0]:
            return float(c[0]), float(c[1])
    levels = np.unique(y)
    at = float((levels[len(levels) // 2 - 1] + levels[len(levels) // 2]) / 2) if len(levels) > 1 else float(y[0])
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    on = (y > at) != (ny > at)
    if not on.any():
        return tuple(ring.mean(0))
    cut = np.sort(x[on] + (at - y[on]) / (ny[on] - y[on]) * (nx[on] - x[on]))
    k = int(np.argmax(cut[1::2] - cut[0::2]))
    return float((cut[2 * k] + cut[2 * k + 1]) / 2), at


def perceptual_hash(gray: np.ndarray) -> int | None:
    """64 bits: which of the 8 x 8 lowest frequencies of the image at 32 x 32 lie above their median; NULL for an empty image.

    gray has values of 0 to 255. It is made smaller as image libraries do it for bytes: by a Lanczos window of three lobes, first along
    rows, then along columns, rounded to bytes each time.
    """
    if gray.ndim != 2 or not gray.size:
        return None
    small = _resized(_resized(np.clip(np.nan_to_num(gray), 0, 255).round().T, 32).T, 32)
    n = np.arange(32)
    dct = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8]
    value = int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def _resized(a: np.ndarray, n: int) -> np.ndarray:
    """The rows of a as n rows of bytes."""
    scale = len(a) / n
    wide = max(scale, 1.0)
    centre = (np.arange(n) + 0.5) * scale
    low, high = np.maximum((centre - 3 * wide + 0.5).astype(int), 0), np.minimum((centre + 3 * wide + 0.5).astype(int), len(a))
    at = np.arange(len(a))[None, :]
    x = (at + 0.5 - centre[:, None]) / wide
    weight = np.where((np.abs(x) < 3) & (at >= low[:, None]) & (at < high[:, None]), np.sinc(x) * np.sinc(x / 3), 0.0)
    return np.clip(np.floor(weight / weight.sum(1, keepdims=True) @ a + 0.5), 0, 255)


def perceptual_hashes(pixels: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, phash) of grey images (key, row, col, value) with values of 0 to 255; a NULL value is black."""
    return per_chip(pixels, key, F.col(value), "phash", "long", pa.int64(), perceptual_hash)


def cells(rasters: DataFrame, key: str, band: int = 1, value: str = "elev") -> DataFrame:
    """(key, row, col, value) of one band (from 1) of rasters (key, width, bands ARRAY<ARRAY<DOUBLE>>); a raster without that band has no cells."""
    flat = rasters.select(key, "width", F.posexplode(F.get("bands", F.lit(band - 1))).alias("at", value))
    return flat.select(key, F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"), value)
