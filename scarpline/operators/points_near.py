"""Points near other geometries and inside regions, by slabs.

Interiors of polygons are cut into trapezoids (a trapezoidal decomposition): each lies between one left and one right edge for as long
as nothing comes between them. Trapezoids, edges and the boxes of regions alike are items between a left and a right line. The globe is
divided into slabs of latitude, slabs into blocks of longitude. An item is clipped to each slab and goes to those blocks only that it
crosses there (an edge, those within the distance asked for); items that would take very many go to a coarser level of slabs. A point lies
in one block of each level in use. Inside a block items are clipped once more, to thin slabs of about twice the distance, and ordered in
each by their western ends, apart by powers of two of their width, so that a point finds its items by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.functions.geotext import LINE, POINT, RING, read_geometry
from scarpline.session import materialize, release

#: Metres in a degree of latitude (fixed).
METRES_PER_DEG = 111320.0
#: Rows of a block that one task takes at once; blocks with more are divided, points and items each by a hash of their id.
BLOCK_ROWS = 200_000
#: Up to so many divided blocks are told to every task; more are joined.
SENT_BLOCKS = 100_000
#: A block is so many times as wide, in metres, as its slab is high.
BLOCK_WIDTH = 16
#: An item that would go to more blocks than ITEM_BLOCKS goes to a level of slabs STEP times as high (three levels in all).
ITEM_BLOCKS, STEP, LEVELS = 4096, 64, 3
#: Rows that a task handles together.
LOT = 100_000
_PAIRS = 4_000_000
#: Latitudes and longitudes beyond these take no part.
_FAR_LAT, _FAR_LON = 1_000.0, 1e6
EDGE, TRAPEZOID, BOX, SPOT = 0, 1, 2, 3

_ROWS = "block long, kind int, id long, a double, b double, c double, d double, e double, f double, west double, name string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _counts(slab: np.ndarray, height: np.ndarray | float, reach: float) -> np.ndarray:
    """How many blocks of longitude a slab has: each at least BLOCK_WIDTH slab heights wide, wherever in the slab or within reach of it."""
    a, b = np.abs(slab * height), np.abs((slab + 1) * height)
    far, low = np.maximum(a, b) + reach, np.minimum(a, b) - reach
    cos = np.where((low < 90) & (far > 90), 0.0, np.minimum(np.abs(np.cos(np.radians(far))), np.abs(np.cos(np.radians(low)))))
    return np.maximum(1, np.floor(360.0 * cos / (BLOCK_WIDTH * height))).astype(np.int64)


def _key(level: np.ndarray | int, slab: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Block -1 is the one for longitudes that are none."""
    return (np.int64(level) << 48) | ((slab + (1 << 23)) << 24) | (block + 1)


def _point_rows(lat: np.ndarray, lon: np.ndarray, height: float, reach: float, levels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(point, key)."""
    who, keys, every = [], [], np.arange(len(lat))
    for level in levels:
        h = height * STEP**level
        slab = np.floor(lat / h).astype(np.int64)
        n = _counts(slab, h, reach)
        out = np.flatnonzero(np.abs(lon) > 180)
        who += [every, out]
        keys += [_key(level, slab, np.minimum(np.floor(lon % 360.0 / (360.0 / n)).astype(np.int64), n - 1)), _key(level, slab[out], np.full(len(out), -1))]
    return np.concatenate(who), np.concatenate(keys)


def _hull(kind: int, v: np.ndarray) -> np.ndarray:
    """Items as (lower, upper latitude, left line from, to, right line from, to)."""
    if kind == TRAPEZOID:
        return v[:, :6]
    if kind == BOX:
        west, east = np.clip(v[:, 0], -2 * _FAR_LON, 2 * _FAR_LON), np.clip(v[:, 2], -2 * _FAR_LON, 2 * _FAR_LON)
        south, north = np.clip(v[:, 1], -2 * _FAR_LAT, 2 * _FAR_LAT), np.clip(v[:, 3], -2 * _FAR_LAT, 2 * _FAR_LAT)
        east = np.where(v[:, 0] <= v[:, 2], east, east + 360.0)
        return np.stack([south, north, west, west, east, east], 1)
    up = (v[:, 1] <= v[:, 3])[:, None]
    p, q = np.where(up, v[:, 0:2], v[:, 2:4]), np.where(up, v[:, 2:4], v[:, 0:2])
    flat = p[:, 1] == q[:, 1]
    low, high = np.minimum(p[:, 0], q[:, 0]), np.maximum(p[:, 0], q[:, 0])
    return np.stack([p[:, 1], q[:, 1], np.where(flat, low, p[:, 0]), np.where(flat, low, q[:, 0]), np.where(flat, high, p[:, 0]), np.where(flat, high, q[:, 0])], 1)


def _span(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longitudes that items take up between two latitudes."""
    tall = np.where(h[:, 1] > h[:, 0], h[:, 1] - h[:, 0], 1.0)
    t0, t1 = np.clip((low - h[:, 0]) / tall, 0, 1), np.clip((high - h[:, 0]) / tall, 0, 1)
    at = lambda a, b, t: h[:, a] + t * (h[:, b] - h[:, a])
    return np.minimum(at(2, 3, t0), at(2, 3, t1)), np.maximum(at(4, 5, t0), at(4, 5, t1))


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) for each row n times."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)


def _spread(h: np.ndarray, height: float, reach: float, pad: float, round_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, key, west): the blocks that items cross, widened by pad degrees of latitude and as many metres of longitude.

    west is the block's number on a line that goes on beyond the meridian where the item's longitudes begin; NaN if the item goes all
    round. round_: boxes over the 180th meridian, which take every longitude that is none besides.
    """
    low, high = np.clip(h[:, 0] - pad, -_FAR_LAT, _FAR_LAT), np.clip(h[:, 1] + pad, -_FAR_LAT, _FAR_LAT)
    ok = (low <= high) & (h[:, 0] <= h[:, 1])
    wide = np.maximum(h[:, 4] - h[:, 2], h[:, 5] - h[:, 3])
    whole = np.maximum(h[:, 4], h[:, 5]) - np.minimum(h[:, 2], h[:, 3])
    level = np.zeros(len(h), np.int64)
    for k in range(LEVELS - 1):
        size = height * STEP**k
        n = (high - low) / size + 1
        level[(n * (1 + wide / (BLOCK_WIDTH * size)) + (whole - wide) / (BLOCK_WIDTH * size) > ITEM_BLOCKS) & (level == k)] = k + 1
    rows, keys, wests = [], [], []
    for k in np.unique(level[ok]):
        own, size = np.flatnonzero(ok & (level == k)), height * STEP ** int(k)
        s0 = np.floor(low[own] / size).astype(np.int64)
        r, j = _repeat(np.floor(high[own] / size).astype(np.int64) - s0 + 1)
        slab, row = s0[r] + j, own[r]
        x0, x1 = _span(h[row], slab * size - pad, (slab + 1) * size + pad)
        count = _counts(slab, size, reach)
        width = 360.0 / count
        more = pad * width / (BLOCK_WIDTH * size) * 1.0000001 + 1e-9
        x0, x1 = np.clip(x0, -_FAR_LON, _FAR_LON) - more, np.clip(x1, -_FAR_LON, _FAR_LON) + more
        b0 = np.floor(x0 / width).astype(np.int64)
        m = np.floor(x1 / width).astype(np.int64) - b0 + 1
        again, j = _repeat(np.minimum(m, count))
        block = b0[again] + j
        rows.append(row[again])
        keys.append(_key(int(k), slab[again], block % count[again]))
        wests.append(np.where((m >= count)[again], np.nan, block))
        if round_ is not None:
            o = np.flatnonzero(round_[row])
            rows.append(row[o])
            keys.append(_key(int(k), slab[o], np.full(len(o), -1)))
            wests.append(np.full(len(o), np.nan))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(wests)


def _trapezoids(shape: np.ndarray, x0, y0, x1, y1, at_once: int = _PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(shape, rows of lower, upper latitude, left line from, to, right line from, to) of the even-odd interior of each shape's ring edges."""
    up = y0 != y1
    shape, x0, y0, x1, y1 = (v[up] for v in (shape, x0, y0, x1, y1))
    swap = y0 > y1
    x0, x1, y0, y1 = np.where(swap, x1, x0), np.where(swap, x0, x1), np.where(swap, y1, y0), np.where(swap, y0, y1)
    if not len(shape):
        return np.zeros(0, np.int64), np.zeros((0, 6))
    who, ys = np.r_[shape, shape], np.r_[y0, y1]
    order = np.lexsort((ys, who))
    who, ys = who[order], ys[order]
    new = np.r_[True, (who[1:] != who[:-1]) | (ys[1:] != ys[:-1])]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    ys = np.r_[ys[new], np.inf]
    lo, hi = rank[: len(shape)], rank[len(shape) :]
    load = np.r_[0, np.cumsum(np.cumsum(np.bincount(lo, minlength=len(ys)) - np.bincount(hi, minlength=len(ys))))]
    out, begin = [], 0
    while begin < len(ys) - 1:  # some millions of crossings of edges and vertex latitudes at a time
        end = max(begin + 1, int(np.searchsorted(load, load[begin] + at_once, "right")) - 1)
        own = np.flatnonzero((lo < end) & (hi > begin))
        r, j = _repeat(np.minimum(hi[own], end) - np.maximum(lo[own], begin))
        e, slab = own[r], np.maximum(lo[own], begin)[r] + j
        slope = (x1[e] - x0[e]) / (y1[e] - y0[e])
        xa, xb = x0[e] + (ys[slab] - y0[e]) * slope, x0[e] + (ys[slab + 1] - y0[e]) * slope
        k = np.lexsort((xa + xb, slab))  # closed rings cross each slab an even number of times
        left, right, s = e[k[0::2]], e[k[1::2]], slab[k[0::2]]
        k = np.lexsort((s, right, left))
        left, right, s = left[k], right[k], s[k]
        first = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (s[1:] != s[:-1] + 1)] if len(s) else np.zeros(0, bool)
        a = np.flatnonzero(first)
        b = np.r_[a[1:] - 1, len(s) - 1] if len(a) else a
        ya, yb, le, ri = ys[s[a]], ys[s[b] + 1], left[a], right[a]
        line = lambda e, y: x0[e] + (y - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
        out.append((shape[le], np.stack([ya, yb, line(le, ya), line(le, yb), line(ri, ya), line(ri, yb)], 1)))
        begin = end
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _item_rows(kind: int, ids: np.ndarray, v: np.ndarray, key: np.ndarray, west: np.ndarray, names: pa.Array | None = None) -> pa.RecordBatch:
    empty = pa.nulls(len(v), pa.float64())
    cols = [pa.array(np.ascontiguousarray(v[:, k])) if k < v.shape[1] else empty for k in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(v), kind, np.int32)), pa.array(ids), *cols, pa.array(west), names if names is not None else pa.nulls(len(v), pa.string())], names=_NAMES)


def shapes(geometries: DataFrame, key: str, geometry: str, distance_m: float, height: float) -> DataFrame:
    """Edges (a, b to c, d as lon, lat) and trapezoids of each geometry, once for each block they can matter to."""
    reach = distance_m / METRES_PER_DEG * 1.0000001

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, edges, ring_edges, n = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = read_geometry(text)
                if not parts:
                    continue
                ids.append(i)
                for kind, v in parts:
                    if kind == POINT or len(v) == 1:
                        edges.extend((n, x, y, x, y) for x, y in v)
                        continue
                    if kind == RING and v[0] != v[-1]:
                        v = [*v, v[0]]
                    own = [(n, *p, *q) for p, q in zip(v, v[1:])]
                    edges.extend(own)
                    if kind != LINE:
                        ring_edges.extend(own)
                n += 1
            ids = np.array(ids, dtype=np.int64)
            if edges:
                g = np.array(edges, dtype=float)
                row, block, west = _spread(_hull(EDGE, g[:, 1:]), height, reach, reach)
                yield _item_rows(EDGE, ids[g[row, 0].astype(np.int64)], g[row, 1:], block, west)
            if ring_edges:
                r = np.array(ring_edges, dtype=float)
                who, t = _trapezoids(r[:, 0].astype(np.int64), *(r[:, k] for k in (1, 2, 3, 4)))
                row, block, west = _spread(t, height, reach, 0.0)
                yield _item_rows(TRAPEZOID, ids[who[row]], t[row], block, west)

    return geometries.select(F.col(key).cast("long").alias("id"), F.col(geometry).alias("g")).where("id is not null and g is not null").mapInArrow(cut, _ROWS)


def boxes(regions: DataFrame, name: str, bbox: str, distance_m: float, height: float) -> DataFrame:
    """The boxes of regions (a, b to c, d as west, south, east, north; f: placed for longitudes that are none), once for each block they cross."""
    reach = distance_m / METRES_PER_DEG * 1.0000001

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)] + [np.zeros(len(batch))] * 2, 1)
            row, block, west = _spread(_hull(BOX, v), height, reach, 0.0, v[:, 0] > v[:, 2])
            v = v[row]
            v[:, 5] = (block & 0xFFFFFF) == 0
            yield _item_rows(BOX, np.zeros(len(v), np.int64), v, block, west, batch.column(0).take(pa.array(row)))

    r = regions.select(F.col(name).alias("name"), F.col(bbox).alias("box")).where("name is not null and size(box) = 4")
    r = r.select("name", *[F.col("box")[k].cast("double").alias(c) for k, c in enumerate("wsen")]).where(" and ".join(f"{c} is not null and not isnan({c})" for c in "wsen")).distinct()
    return r.mapInArrow(cut, _ROWS)


def _near(lat, lon, ax, ay, bx, by, limit) -> np.ndarray:
    """Whether edges come within limit metres of points, in the flat plane around each point."""
    shift = 360.0 * np.round((ax - lon) / 360.0)
    cos = np.cos(np.radians(lat))
    x0, y0, x1, y1 = (ax - lon - shift) * cos, ay - lat, (bx - lon - shift) * cos, by - lat
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    t = np.clip(-(x0 * dx + y0 * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    return METRES_PER_DEG * np.hypot(x0 + t * dx, y0 + t * dy) <= limit


def _within(lat, lon, ylo, yhi, l0, l1, r0, r1) -> np.ndarray:
    t = (lat - ylo) / np.where(yhi > ylo, yhi - ylo, 1.0)
    x = lon + 360.0 * np.round((l0 - lon) / 360.0)
    left, right = l0 + t * (l1 - l0), r0 + t * (r1 - r0)
    return (lat >= ylo) & (lat <= yhi) & (((x >= left) & (x <= right)) | ((x + 360 >= left) & (x + 360 <= right)) | ((x - 360 >= left) & (x - 360 <= right)))


def _held(lat, lon, w, s, e, n, _, none) -> np.ndarray:
    plain = (lon >= w) & (lon <= e)
    round_ = ((lon >= w) | (lon <= e)) & ((np.abs(lon) > 180) == (none > 0))
    return (lat >= s) & (lat <= n) & np.where(w <= e, plain, round_)


def _matches(kind: int, pk, plat, plon, sk, v, west, limit: float, reach: float, height: float, thin: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, item) of each match. pk, sk: numbers of block and part, with level, slab and block in pk.key and sk.key."""
    (pg, pkey), (sg, skey) = pk, sk
    none = np.zeros(0, np.int64)
    if not len(pg) or not len(sg):
        return none, none

    def frame(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Height, lower latitude and block width."""
        size = height * float(STEP) ** (key >> 48)
        slab = ((key >> 24) & 0xFFFFFF) - (1 << 23)
        return size, slab * size, 360.0 / _counts(slab, size, reach)

    pad = reach if kind == EDGE else 0.0
    h = _hull(kind, v)
    size, base, width = frame(skey)
    a = np.clip(np.floor((h[:, 0] - pad - 1e-9 - base) / size * thin), 0, thin - 1).astype(np.int64)
    b = np.clip(np.floor((h[:, 1] + pad + 1e-9 - base) / size * thin), 0, thin - 1).astype(np.int64)
    item, j = _repeat(b - a + 1)
    sub = a[item] + j
    size, base, width = size[item], base[item], width[item]
    x0, x1 = _span(h[item], base + sub * size / thin - pad - 1e-9, base + (sub + 1) * size / thin + pad + 1e-9)
    more = pad * width / (BLOCK_WIDTH * size) * 1.0000001 + 1e-9
    left, right = (np.where(np.isnan(west[item]), k, np.clip((x + s * more) / width - west[item], 0, 1)) for x, s, k in ((x0, -1, 0.0), (x1, 1, 1.0)))
    grade = np.clip(np.floor(-np.log2(np.maximum(right - left, 1e-9))), 0, 15).astype(np.int64)
    line = ((sg[item] * thin + sub) * 16 + grade) * 2.0 + left
    order = np.argsort(line, kind="stable")
    line, item = line[order], item[order]
    size, base, width = frame(pkey)
    u = np.clip(plon % 360.0 / width - ((pkey & 0xFFFFFF) - 1), 0, 1)
    cell = (pg * thin + np.clip(np.floor((plat - base) / size * thin), 0, thin - 1).astype(np.int64)) * 16
    out_p, out_s = [], []
    for g in np.unique(grade):
        at = (cell + g) * 2.0
        lo = np.searchsorted(line, at + np.maximum(u - 2.0**-g - 1e-7, -0.5), "left")
        n = np.searchsorted(line, at + u + 1e-7, "right") - lo
        edge = np.r_[0, np.cumsum(n)]
        i = 0
        while i < len(n):  # some millions of candidates at a time
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + _PAIRS, "right")) - 1)
            r, k = _repeat(n[i:j])
            p, c = r + i, item[lo[i:j][r] + k]
            w = v[c].T
            ok = _near(plat[p], plon[p], *w[:4], limit) if kind == EDGE else _within(plat[p], plon[p], *w) if kind == TRAPEZOID else _held(plat[p], plon[p], *w)
            out_p.append(p[ok])
            out_s.append(c[ok])
            i = j
    return np.concatenate(out_p or [none]), np.concatenate(out_s or [none])


def points_near(
    points: DataFrame, point_id: str, lat: str, lon: str,
    geometries: DataFrame, geometry_id: str, geometry: str,
    regions: DataFrame, region_name: str, bbox: str,
    distance_m: float = 60.0, height: float = 0.01,
) -> DataFrame:
    """(point_id, relation, target): 'near' with the id of each geometry within distance_m, 'inside' with the name of each region whose bbox holds the point.

    Distance is 111320 * hypot(dlat, dlon * cos(lat of the point)) to the nearest spot of a point, line or polygon edge, 0 inside a
    polygon; holes are outside. bbox is (lon_min, lat_min, lon_max, lat_max), edges included; if lon_min > lon_max, longitudes from
    lon_min on or up to lon_max. Points with a NULL or NaN coordinate, a latitude beyond 1,000 or a longitude beyond a million,
    geometries and regions that are NULL, NaN or unreadable, and NULL ids take no part. A point counts once: with its smallest
    coordinates, if its rows differ. A geometry or region with several rows counts with all of them, each match once. An empty side gives
    no rows of its relation.

    Points and items meet by block in one shuffle; a block with very many rows is divided by hashes of the ids of both sides, so that no
    task holds an unbounded block, and any number of blocks can be divided.
    """  # noqa: E501
    reach = distance_m / METRES_PER_DEG * 1.0000001
    height = max(height, 2 * reach)
    thin = int(min(16, max(1, height // (2 * reach)))) if reach else 16
    p = points.select(F.col(point_id).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.where(f"id is not null and abs(lat) <= {_FAR_LAT} and abs(lon) <= {_FAR_LON} and not isnan(lat) and not isnan(lon)")
    p = p.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("at")).select("id", "at.lat", "at.lon")
    items = materialize(shapes(geometries, geometry_id, geometry, distance_m, height).unionByName(boxes(regions, region_name, bbox, distance_m, height)))
    levels = sorted(r[0] for r in items.select(F.shiftright("block", 48)).distinct().collect())  # at most LEVELS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            if len(y) and levels:
                who, key = _point_rows(y, x, height, reach, levels)
                yield _item_rows(SPOT, b.column(0).to_numpy()[who], np.stack([y[who], x[who]], 1), key, np.full(len(who), np.nan))

    spots = materialize(p.mapInArrow(place, _ROWS))
    every = spots.unionByName(items)
    counts = every.groupBy("block").agg(F.count_if(F.col("kind") != SPOT).alias("s"), F.count_if(F.col("kind") == SPOT).alias("p"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK_ROWS), F.lit(1)).cast("int").alias(c)
    hot = materialize(counts.where(f"s > {BLOCK_ROWS} or p > {BLOCK_ROWS}").select("block", parts("s"), parts("p")))
    every = every.withColumn("part", F.lit(0).cast("long"))
    n_hot = hot.count()
    if n_hot:
        j = every.join(F.broadcast(hot) if n_hot <= SENT_BLOCKS else hot, "block", "left")  # its size is checked
        mine = lambda n: F.pmod(F.xxhash64("id", "name"), F.coalesce(F.col(n), F.lit(1)))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)).cast("long") - 1)
        each = F.when(F.col("kind") == SPOT, F.transform(upto("s"), lambda k: F.shiftleft(mine("p"), 32) + k)).otherwise(F.transform(upto("p"), lambda k: F.shiftleft(k, 32) + mine("s")))
        every = j.withColumn("part", F.explode(each)).drop("s", "p")
    else:
        release(hot)
    lot = LOT

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by block, part and kind, items before points. Only the items of the last block and part stay for the batches to come."""

        def found(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            kind, key, ids = (t.column(c).to_numpy() for c in ("kind", "block", "id"))
            q = np.flatnonzero(kind == SPOT)
            v = np.stack([t.column(c).to_numpy() for c in "abcdef"], 1)
            west = t.column("west").to_numpy()
            pairs, held = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            names = np.zeros(0, object)
            for k in (EDGE, TRAPEZOID, BOX):
                s = np.flatnonzero(kind == k)
                at, c = _matches(k, (group[q], key[q]), v[q, 0], v[q, 1], (group[s], key[s]), v[s], west[s], distance_m, reach, height, thin)
                if k == BOX and len(s):
                    coded = t.column("name").take(pa.array(s)).combine_chunks().dictionary_encode()
                    names = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
                    held.append(np.unique(np.stack([ids[q[at]], coded.indices.to_numpy()[c].astype(np.int64)], 1), axis=0))
                elif k != BOX:
                    pairs.append(np.stack([ids[q[at]], ids[s[c]]], 1))
            near, held = np.unique(np.concatenate(pairs), axis=0), np.concatenate(held)
            who = pa.array(np.r_[near[:, 0], held[:, 0]])
            relation = pa.array(["near"] * len(near) + ["inside"] * len(held), pa.string())
            target = pa.array([*map(str, near[:, 1].tolist()), *(names[held[:, 1]].tolist() if len(held) else [])], pa.string())
            return pa.RecordBatch.from_arrays([who, relation, target], names=["id", "relation", "target"])

        rest: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rest).combine_chunks()
            block, part = t.column("block").to_numpy(), t.column("part").to_numpy()
            group = np.cumsum(np.r_[0, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
            if (t.column("kind").to_numpy() == SPOT).any():
                yield found(t, group)
            last = t.filter(pa.array((group == group[-1]) & (t.column("kind").to_numpy() != SPOT)))
            rest[:] = last.to_batches()

        size = 0
        for b in batches:
            if len(b):
                rest.append(b)
                size += len(b)
                if size >= lot:
                    yield from flush()
                    size = 0
        if rest:
            yield from flush()

    met = every.repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(locate, "id long, relation string, target string")
    if len(levels) > 1:
        met = met.distinct()  # a geometry may have items on several levels
    return met.select(F.col("id").alias(point_id), "relation", "target")
