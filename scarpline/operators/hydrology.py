"""Elevation grids and drainage: filling, directions, accumulation, channels, ways down."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions.geodesy import cell_size, equirect_km, pixel_centre
from scarpline.operators.graph import walk
from scarpline.session import materialize, release

#: Side of a tile, in cells, of the operators that need neighbours only.
TILE = 256


def _area_grid(pdf: pd.DataFrame, *columns: str, empty: float = np.nan) -> tuple[int, int, list[np.ndarray]]:
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    h, w = int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1
    out = []
    for c in columns:
        g = np.full((h, w), empty, dtype=float)
        g[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf[c].to_numpy()
        out.append(g)
    return r0, c0, out


def priority_flood(z: np.ndarray) -> np.ndarray:
    """Elevations raised until every cell has a way off the grid (Barnes 2014); cells without a value stay so and drain their neighbours."""
    h, w = z.shape
    out = z.copy()
    done = np.isnan(z)
    heap: list[tuple[float, int, int]] = []
    border = np.zeros_like(done)
    border[[0, -1], :] = border[:, [0, -1]] = True
    hole = np.pad(np.isnan(z), 1)
    for dr, dc in C.D8.values():
        border |= hole[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]
    for r, c in zip(*np.nonzero(border & ~done)):
        heap.append((float(z[r, c]), int(r), int(c)))
        done[r, c] = True
    heapq.heapify(heap)
    while heap:
        e, r, c = heapq.heappop(heap)
        for dr, dc in C.D8.values():
            y, x = r + dr, c + dc
            if 0 <= y < h and 0 <= x < w and not done[y, x]:
                done[y, x] = True
                out[y, x] = max(out[y, x], e)
                heapq.heappush(heap, (float(out[y, x]), y, x))
    return out


def d8(z: np.ndarray, size_x: float = 1.0, size_y: float = 1.0) -> np.ndarray:
    """The code of the steepest way down of each cell, the first clockwise from north where several are; 0 where none goes down."""
    p = np.pad(z, 1, constant_values=np.nan)
    best, code = np.zeros(z.shape), np.zeros(z.shape, np.int32)
    for k, (dr, dc) in C.D8.items():
        step = np.hypot(dr * size_y, dc * size_x)
        with np.errstate(invalid="ignore"):
            slope = (z - p[1 + dr : 1 + dr + z.shape[0], 1 + dc : 1 + dc + z.shape[1]]) / step
            better = slope > best
        best[better], code[better] = slope[better], k
    return code


def drain_flats(z: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Codes for flat cells too: each flows to the neighbour of its height that is fewest steps from a way out, the first clockwise."""
    h, w = z.shape
    out = code.copy()
    edge = np.zeros(z.shape, bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    queue = [(int(r), int(c)) for r, c in zip(*np.nonzero((out != 0) | edge))]
    seen = (out != 0) | edge | np.isnan(z)
    at = 0
    back = {k: next(q for q, v in C.D8.items() if v == (-dr, -dc)) for k, (dr, dc) in C.D8.items()}
    while at < len(queue):
        r, c = queue[at]
        at += 1
        for k, (dr, dc) in C.D8.items():
            y, x = r + dr, c + dc
            if 0 <= y < h and 0 <= x < w and not seen[y, x] and z[y, x] == z[r, c]:
                seen[y, x] = True
                out[y, x] = back[k]
                queue.append((y, x))
    return out


def accumulation(code: np.ndarray) -> np.ndarray:
    """How many cells drain through each cell, itself included, in topological order."""
    h, w = code.shape
    to = np.full(h * w, -1, np.int64)
    rows, cols = np.indices((h, w))
    for k, (dr, dc) in C.D8.items():
        y, x = rows + dr, cols + dc
        m = (code == k) & (y >= 0) & (y < h) & (x >= 0) & (x < w)
        to[(rows * w + cols)[m]] = (y * w + x)[m]
    acc, waiting = np.ones(h * w, np.int64), np.bincount(to[to >= 0], minlength=h * w)
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        flow = ready[to[ready] >= 0]
        np.add.at(acc, to[flow], acc[flow])
        np.subtract.at(waiting, to[flow], 1)
        ready = np.unique(to[flow])
        ready = ready[waiting[ready] == 0]
    return acc.reshape(h, w)


def fill_depressions(dem: DataFrame, area: str = "area") -> DataFrame:
    """dem (area, row, col, elev) with filled: elevations without pits and depressions. One area is one task's work: filling is global to it."""
    kind = dem.schema[area].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (z,) = _area_grid(pdf, "elev")
        return pdf.assign(filled=priority_flood(z)[pdf["row"] - r0, pdf["col"] - c0])

    return dem.select(area, "row", "col", F.col("elev").cast("double").alias("elev")).groupBy(area).applyInPandas(run, f"`{area}` {kind}, row int, col int, elev double, filled double")


def flow_directions(dem: DataFrame, area: str = "area", elev: str = "elev", size_x: float = 1.0, size_y: float = 1.0) -> DataFrame:
    """(area, row, col, elev, direction) by tiles with a rim of one cell: no task needs more than a tile."""
    kind = dem.schema[area].dataType.simpleString()

    def near(c: str) -> Column:
        t = F.floor(F.col(c) / TILE).cast("int")
        rest = F.pmod(F.col(c), F.lit(TILE))
        return F.filter(F.array(t, F.when(rest == 0, t - 1), F.when(rest == TILE - 1, t + 1)), lambda x: x.isNotNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (z,) = _area_grid(pdf, "elev")
        own = pdf[(pdf["row"] // TILE == pdf["tr"]) & (pdf["col"] // TILE == pdf["tc"])]
        return own.assign(direction=d8(z, size_x, size_y)[own["row"] - r0, own["col"] - c0])[[area, "row", "col", "elev", "direction"]]

    spread = dem.select(area, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(elev).cast("double").alias("elev"))
    spread = spread.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    return spread.groupBy(area, "tr", "tc").applyInPandas(run, f"`{area}` {kind}, row int, col int, elev double, direction int")


def flow_accumulation(cells: DataFrame, area: str = "area") -> DataFrame:
    """cells (area, row, col, elev, direction) with accumulation, the number of cells upstream and itself."""
    kind = cells.schema[area].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (code,) = _area_grid(pdf, "direction", empty=0)
        return pdf.assign(accumulation=accumulation(code.astype(np.int32))[pdf["row"] - r0, pdf["col"] - c0])

    return cells.select(area, "row", "col", "elev", "direction").groupBy(area).applyInPandas(run, f"`{area}` {kind}, row int, col int, elev double, direction int, accumulation long")


def drained(dem: DataFrame, area: str = "area", size_x: float = 1.0, size_y: float = 1.0) -> DataFrame:
    """(area, row, col, elev, direction, accumulation) of a raw grid: filled, flats drained, directions and accumulation, an area at a time."""
    kind = dem.schema[area].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (z,) = _area_grid(pdf, "elev")
        full = priority_flood(z)
        code = drain_flats(full, d8(full, size_x, size_y))
        at = (pdf["row"] - r0, pdf["col"] - c0)
        return pdf.assign(direction=code[at], accumulation=accumulation(code)[at])

    return dem.select(area, "row", "col", F.col("elev").cast("double").alias("elev")).groupBy(area).applyInPandas(run, f"`{area}` {kind}, row int, col int, elev double, direction int, accumulation long")


def channel_nodes(cells: DataFrame, threshold: int = C.CHANNEL_THRESHOLD) -> DataFrame:
    """Cells with more than threshold cells upstream."""
    return cells.where(F.col("accumulation") > threshold)


def edge_length(direction: Column, size_x: Column | float, size_y: Column | float) -> Column:
    """Diagonal, vertical or horizontal step."""
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (size_x, size_y))
    return F.when(direction.isin(128, 2, 8, 32), F.hypot(x, y)).when(direction.isin(64, 4), y).when(direction.isin(1, 16), x)


def channel_edges(nodes: DataFrame, area: str = "area", size_x: float = 1.0, size_y: float = 1.0) -> DataFrame:
    """(area, row, col, to_row, to_col, distance_m): each channel cell to the next, where that is a channel cell too."""
    dr = dc = F.lit(None).cast("int")
    for k, (r, c) in C.D8.items():
        dr, dc = F.when(F.col("direction") == k, r).otherwise(dr), F.when(F.col("direction") == k, c).otherwise(dc)
    steps = nodes.select(area, "row", "col", (F.col("row") + dr).alias("to_row"), (F.col("col") + dc).alias("to_col"), edge_length(F.col("direction"), size_x, size_y).alias("distance_m"))
    goal = nodes.select(area, F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return steps.join(goal, [area, "to_row", "to_col"]).select(area, "row", "col", "to_row", "to_col", "distance_m")


def drainage_graph(dem: DataFrame, grids: DataFrame, area: str = "area", threshold: int = C.CHANNEL_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of raw elevation grids: dem (area, row, col, elev), grids (area, transform ARRAY<DOUBLE>, height) in degrees.

    nodes (area, node, row, col, lat, lon, direction, accumulation, upstream_area_km2) are the cells with more than threshold cells
    upstream; edges (area, src, dst, dist) in metres go from each to the next on its way down, where that is a node too. node is
    'area:row:col'. An area without a grid has none. Every way ends, as directions lead down or to the way out of a flat.
    """
    full = channel_nodes(drained(dem, area), threshold)
    at = full.join(grids.select(area, "transform", cell_size("transform", "height").alias("_cell")), area)
    name = lambda r, c: F.concat_ws(":", F.col(area).cast("string"), r, c)
    nodes = at.select(
        area, name("row", "col").alias("node"), "row", "col", pixel_centre("transform", "row", "col").alias("_p"), "direction", "accumulation",
        (F.col("accumulation") * F.col("_cell.area_km2")).alias("upstream_area_km2"), F.col("_cell.x_m").alias("x_m"), F.col("_cell.y_m").alias("y_m"),
    )
    nodes = materialize(nodes.select(area, "node", "row", "col", F.col("_p.y").alias("lat"), F.col("_p.x").alias("lon"), "direction", "accumulation", "upstream_area_km2", "x_m", "y_m"))
    edges = channel_edges(nodes, area, F.col("x_m"), F.col("y_m"))
    edges = edges.select(area, name("row", "col").alias("src"), name("to_row", "to_col").alias("dst"), F.col("distance_m").alias("dist"))
    return nodes.drop("x_m", "y_m"), edges


def graph_summary(nodes: DataFrame, edges: DataFrame, area: str = "area") -> DataFrame:
    """(area, n_nodes, n_edges, max_upstream_area_km2) for each area with nodes."""
    n = nodes.groupBy(area).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("upstream_area_km2").alias("max_upstream_area_km2"))
    e = edges.groupBy(area).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, area, "left").select(area, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "max_upstream_area_km2")


#: Up to so many nodes every point is held against all of them; with more, cells are used.
SENT_NODES = 2_000
#: A wide cell is looked at by its PARTS x PARTS parts first, each by one of its nodes.
PARTS = 16


def nearest(points: DataFrame, nodes: DataFrame, key: str, node: str, area: str | None = None, cell: float | None = None, max_rounds: int = 40) -> DataFrame:
    """(key, node, d2): for each point (key, lat, lon) the node (node, lat, lon) nearest in degrees, the smallest of equal ones.

    Points and nodes meet in cells and their neighbours, by default of such a size that two nodes are in one on average; a point whose
    nearest lies farther away than a cell goes on with cells four times as wide, of which it sees one node for each part and then the nodes
    of those parts only that may hold a nearer one. area, if given, must agree; a point of an area without nodes has no row, nor has any
    point where there are no nodes. Points with a NULL coordinate and nodes with one take no part.
    """
    on = [area] if area else []
    p = points.select(key, *on, "lat", "lon").where("lat is not null and lon is not null")
    n = nodes.select(*on, F.col(node).alias("_node"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).where("_lat is not null and _lon is not null")
    d2 = (F.col("lat") - F.col("_lat")) * (F.col("lat") - F.col("_lat")) + (F.col("lon") - F.col("_lon")) * (F.col("lon") - F.col("_lon"))
    best = F.min(F.struct(d2.alias("d2"), F.col("_node").alias("node"))).alias("b")
    if n.limit(SENT_NODES + 1).count() <= SENT_NODES:
        near = F.broadcast(n)  # at most SENT_NODES rows
        every = p.join(near, on) if on else p.crossJoin(near)
        return every.groupBy(key).agg(best).select(key, F.col("b.node").alias(node), F.col("b.d2").alias("d2"))
    if cell is None:
        b = n.agg((F.max("_lat") - F.min("_lat")).alias("h"), (F.max("_lon") - F.min("_lon")).alias("w"), F.count(F.lit(1)).alias("n")).first()
        cell = max((2 * max(b["h"], 1e-3) * max(b["w"], 1e-3) / b["n"]) ** 0.5, 1e-4)
    at = lambda c, size: F.floor(F.col(c) / size)
    ring = F.array(*map(F.lit, (-1, 0, 1)))
    out, rest = [], p.join(n.select(*on).distinct(), on, "left_semi") if on else p
    for k in range(max_rounds):
        size, part = cell, cell / PARTS
        q = rest.withColumn("_di", F.explode(ring)).withColumn("_dj", F.explode(ring)).withColumn("_i", at("lat", size) + F.col("_di")).withColumn("_j", at("lon", size) + F.col("_dj"))
        if k == 0:
            m = n.withColumn("_i", at("_lat", size)).withColumn("_j", at("_lon", size))
            met = q.join(m, [*on, "_i", "_j"])
        else:
            parts = n.withColumn("_pi", at("_lat", part)).withColumn("_pj", at("_lon", part)).groupBy(*on, "_pi", "_pj").agg(F.min(F.struct("_lat", "_lon")).alias("one"))
            parts = parts.select(*on, "_pi", "_pj", "one._lat", "one._lon", F.floor(F.col("_pi") / PARTS).alias("_i"), F.floor(F.col("_pj") / PARTS).alias("_j"))
            off = lambda c, i: F.greatest(F.col(i) * part - F.col(c), F.col(c) - (F.col(i) + 1) * part, F.lit(0.0))  # noqa: B023, E731
            least = (off("lat", "_pi") * off("lat", "_pi") + off("lon", "_pj") * off("lon", "_pj")) * (1 - 1e-12)
            seen = q.join(parts, [*on, "_i", "_j"]).groupBy(key, *on, "lat", "lon").agg(F.min(d2).alias("_most"), F.collect_list(F.struct(least.alias("least"), "_pi", "_pj")).alias("_parts"))  # at most 9 x PARTS x PARTS
            some = seen.select(key, *on, "lat", "lon", F.inline(F.filter("_parts", lambda x: x["least"] <= F.col("_most"))))
            met = some.join(n.withColumn("_pi", at("_lat", part)).withColumn("_pj", at("_lon", part)), [*on, "_pi", "_pj"])
        got = met.groupBy(key).agg(best).select(key, F.col("b.node").alias(node), F.col("b.d2").alias("d2"))
        got = materialize(got.where(F.col("d2") <= size * size))
        out.append(got)
        left = materialize(rest.join(got.select(key), key, "left_anti"))
        release(rest)
        rest = left
        cell *= 4
        if rest.isEmpty():
            release(rest)
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    found = out[0]
    for got in out[1:]:
        found = found.unionByName(got)
    return found


def channel_distance_km(points: DataFrame, nodes: DataFrame, key: str, node: str, area: str | None = None) -> DataFrame:
    """(key, node, distance_km): the nearest node in degrees and its distance in the plane around the point."""
    found = nearest(points, nodes, key, node, area)
    at = nodes.select(node, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return found.join(at, node).join(points.select(key, "lat", "lon"), key).select(key, node, equirect_km("lat", "lon", "_lat", "_lon").alias("distance_km"))


def downstream(starts: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, node: str, max_km: float = C.WALK_KM) -> DataFrame:
    """(key, seq, node, lat, lon, distance_km): the way down from each start's node; a step beyond max_km ends at max_km, between its nodes, without a node."""
    limit = max_km * 1000
    rows = materialize(walk(starts, edges, key, node, limit))
    at = nodes.select(F.col(node).alias("node"), "lat", "lon")
    full = rows.join(at, "node")
    over = full.where(F.col("dist") > limit).withColumn("seq", F.col("seq") - 1).select(key, "seq", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("dist").alias("dist2"))
    last = full.join(over, [key, "seq"]).withColumn("f", (limit - F.col("dist")) / (F.col("dist2") - F.col("dist")))
    clipped = last.select(key, (F.col("seq") + 1).alias("seq"), F.lit(None).cast(full.schema["node"].dataType).alias("node"), (F.col("lat") + F.col("f") * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + F.col("f") * (F.col("lon2") - F.col("lon"))).alias("lon"), F.lit(float(max_km)).alias("distance_km"))
    inside = full.where(F.col("dist") <= limit).select(key, "seq", "node", "lat", "lon", (F.col("dist") / 1000).alias("distance_km"))
    return inside.unionByName(clipped)


def half_window(pixel_m: Column, window_km: float = C.RELIEF_WINDOW_KM) -> Column:
    """Half a window in pixels, at least 1; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(window_km * 1000 / 2) / pixel_m).cast("int"))


def local_relief(points: DataFrame, dem: DataFrame, key: str, half: int | Column, area: str = "area", tile: int = TILE) -> DataFrame:
    """(key, relief): highest less lowest elevation within half cells of each point (key, area, row, col); no row where no cell is near.

    Points go to the tiles their windows touch, so that cells move once, by tile.
    """
    h = half if isinstance(half, Column) else F.lit(half)
    p = points.select(key, area, F.col("row").alias("_r"), F.col("col").alias("_c"), h.alias("_h"))
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("_h")) / tile).cast("int"), F.floor((F.col(c) + F.col("_h")) / tile).cast("int"))
    p = p.withColumn("_tr", F.explode(span("_r"))).withColumn("_tc", F.explode(span("_c")))
    d = dem.select(area, "row", "col", "elev", F.floor(F.col("row") / tile).cast("int").alias("_tr"), F.floor(F.col("col") / tile).cast("int").alias("_tc"))
    near = (F.abs(F.col("row") - F.col("_r")) <= F.col("_h")) & (F.abs(F.col("col") - F.col("_c")) <= F.col("_h"))
    return p.join(d, [area, "_tr", "_tc"]).where(near).groupBy(key).agg((F.max("elev") - F.min("elev")).alias("relief"))


def rows_and_cols(points: DataFrame, grids: DataFrame, area: str = "area") -> DataFrame:
    """points (area, lat, lon) with row, col in their area's grid (area, transform, width, height) and half, half a relief window in its pixels; NULL outside of it."""
    from scarpline.functions.geodesy import pixel_of

    g = grids.select(area, F.col("transform").alias("_t"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    j = points.join(g, area, "left").withColumn("_p", pixel_of("_t", "lon", "lat"))
    ok = F.col("_p.row").between(0, F.col("_h") - 1) & F.col("_p.col").between(0, F.col("_w") - 1)
    half = half_window(F.abs(F.col("_t")[0]) * C.METRES_PER_DEG)
    return j.select(*points.columns, F.when(ok, F.col("_p.row")).alias("row"), F.when(ok, F.col("_p.col")).alias("col"), F.when(ok, half).alias("half"))


def channel_masks(nodes: DataFrame, grids: DataFrame, area: str = "area") -> DataFrame:
    """(area, tiff): for each grid (area, transform, width, height) a GeoTIFF of bytes, 1 where a node (area, row, col) is, else 0. One area's mask is one task's work."""
    from scarpline.sources.geotiff import write_geotiff

    kind = grids.schema[area].dataType.simpleString()
    spots = nodes.groupBy(area).agg(F.collect_list(F.struct("row", "col")).alias("spots"))

    def run(batches):
        for b in batches:
            out = []
            for w, h, t, s in zip(b["width"], b["height"], b["transform"], b["spots"]):
                g = np.zeros((1, int(h), int(w)), np.uint8)
                for x in s if s is not None else []:
                    g[0, x["row"], x["col"]] = 1
                out.append(write_geotiff(g, [float(v) for v in t], 4326, compress=True))
            yield pd.DataFrame({area: b[area], "tiff": out})

    return grids.select(area, "width", "height", "transform").join(spots, area, "left").mapInPandas(run, f"`{area}` {kind}, tiff binary")


def lookup_terrain(points: DataFrame, nodes: DataFrame, dem: DataFrame, areas: DataFrame, key: str, node: str, half: int | Column) -> DataFrame:
    """points (key, area, lat, lon, row, col) with nearest node, its upstream_area_km2, distance and relief (or the area's fallback, marked as not real)."""
    where = channel_distance_km(points, nodes, key, node, "area")
    relief = local_relief(points, dem, key, half)
    out = points.join(where, key, "left").join(nodes.select(node, "upstream_area_km2"), node, "left").join(relief, key, "left")
    fall = areas.select(F.col("name").alias("area"), F.col("local_relief_fallback_m").alias("_fall"))
    out = out.join(fall, "area", "left")
    return out.select(
        key, "area", node, "upstream_area_km2", F.coalesce("relief", "_fall").alias("local_relief_m"), F.col("relief").isNotNull().alias("local_relief_is_real"),
        F.col("distance_km").alias("distance_to_channel_km"),
    )
