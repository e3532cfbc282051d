import math
import random

import pytest

from scarpline.functions.geotext import RING, read_geometry
from scarpline.operators import points_near as N


def brute(points, shapes, areas, limit=60.0):
    out = set()
    for i, lat, lon in points:
        if i is None or lat is None or lon is None or math.isnan(lat) or math.isnan(lon):
            continue
        for j, text in shapes:
            parts = read_geometry(text)
            if not parts or j is None:
                continue
            x = lon + 360 * round((parts[0][1][0][0] - lon) / 360)
            best, inside, c = 1e18, False, math.cos(math.radians(lat))
            for kind, v in parts:
                if kind == RING and v[0] != v[-1]:
                    v = [*v, v[0]]
                for (x0, y0), (x1, y1) in zip(v, v[1:] or v):
                    a, b, p, q = (x0 - x) * c, y0 - lat, (x1 - x0) * c, y1 - y0
                    t = min(1, max(0, -(a * p + b * q) / (p * p + q * q))) if p or q else 0
                    best = min(best, 111320 * math.hypot(a + t * p, b + t * q))
                    if kind == RING and (y0 > lat) != (y1 > lat) and x < x0 + (lat - y0) / (y1 - y0) * (x1 - x0):
                        inside = not inside
            if inside or best <= limit:
                out.add((i, "near", str(j)))
        for name, box in areas:
            if name is None or box is None:
                continue
            w, s, e, n = box
            if s <= lat <= n and (w <= lon <= e if w <= e else lon >= w or lon <= e):
                out.add((i, "inside", name))
    return out


def run(spark, points, shapes, areas, **kw):
    p = spark.createDataFrame([(*r, "x", 1) for r in points], "pid long, lat double, lon double, block string, id int")
    g = spark.createDataFrame([(*r, "y") for r in shapes], "gid long, geom string, lat string")
    a = spark.createDataFrame(areas, "name string, bbox array<double>")
    r = N.points_near(p, "pid", "lat", "lon", g, "gid", "geom", a, "name", "bbox", **kw)
    rows = [tuple(x) for x in r.collect()]
    assert len(rows) == len(set(rows)) and r.columns == ["pid", "relation", "target"]
    return set(rows)


def scene(seed, n=300):
    rnd = random.Random(seed)
    at = lambda c, s: (c[0] + rnd.uniform(-s, s), c[1] + rnd.uniform(-s, s))
    centres = [(85.0, 28.0), (179.9999, -17.0), (-179.9999, -17.0), (10.0, 69.9), (0.0, 0.0)]
    shapes = []
    for j in range(n):
        c = at(rnd.choice(centres), 0.01)
        wrap = lambda x: (x + 180) % 360 - 180
        if j % 3 == 0:
            shapes.append((j, f"POINT ({wrap(c[0])!r} {c[1]!r})"))
        elif j % 3 == 1:
            shapes.append((j, "LINESTRING (" + ", ".join(f"{wrap(x)!r} {y!r}" for x, y in (at(c, 0.003) for _ in range(4))) + ")"))
        else:
            ring = [(c[0] + 0.004 * math.cos(k) * rnd.uniform(0.5, 1), c[1] + 0.004 * math.sin(k) * rnd.uniform(0.5, 1)) for k in (0.1, 1, 2, 3, 4, 5, 6)]
            hole = [(c[0] + 0.001 * math.cos(k), c[1] + 0.001 * math.sin(k)) for k in (0, 2, 4)]
            text = lambda r: "(" + ", ".join(f"{wrap(x)!r} {y!r}" for x, y in [*r, r[0]]) + ")"
            shapes.append((j, f"POLYGON ({text(ring)}, {text(hole)})"))
    points = [(i, *reversed(at(rnd.choice(centres), 0.012))) for i in range(n)]
    points = [(i, y, (x + 180) % 360 - 180) for i, y, x in points]
    return points, shapes


AREAS = [("a", [84.9, 27.9, 85.0, 28.0]), ("b", [179.5, -18.0, -179.5, -16.0]), ("c", [85.0, 28.0, 86.0, 29.0]), ("all", [-180.0, -90.0, 180.0, 90.0]), (None, [0.0, 0.0, 1.0, 1.0]), ("none", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    points, shapes = scene(seed)
    points += [(1000, 28.0, 85.0), (1001, None, 85.0), (1002, 28.0, None), (1003, float("nan"), 1.0), (None, 28.0, 85.0), (1004, 120.0, 28.0), (1005, 89.9999, 7.0)]
    shapes += [(2000, None), (2001, ""), (2002, "POINT EMPTY"), (2003, "what"), (None, "POINT (85 28)"), (2004, "POINT (190 89.9999)")]
    assert run(spark, points + points[:50], shapes + shapes[:50], AREAS) == brute(points, shapes, AREAS)


def test_divided_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    points, shapes = scene(3)
    assert run(spark, points, shapes, AREAS) == brute(points, shapes, AREAS)


def test_coarse_levels(spark, monkeypatch):
    monkeypatch.setattr(N, "ITEM_BLOCKS", 50)
    points, shapes = scene(4, 60)
    shapes += [(500, "LINESTRING (84.9 27.9, 85.9 28.9)"), (501, "POLYGON ((84 27, 86 27, 86 29, 84 29, 84 27), (84.99 27.99, 85.005 27.99, 85.005 28.005, 84.99 28.005, 84.99 27.99))")]
    many = [(f"r{k}", [85.0 - k * 0.001, 28.0 - k * 0.002, 85.0 + k * 0.003, 28.0 + k * 0.001]) for k in range(200)]
    assert run(spark, points, shapes, AREAS + many) == brute(points, shapes, AREAS + many)


def test_boxes_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    areas = [("wrap", [179.0, -5.0, -179.0, 5.0]), ("nan", [nan, -5.0, 1.0, 5.0]), ("upside", [0.0, 5.0, 1.0, -5.0]), ("spot", [3.0, 3.0, 3.0, 3.0]), ("endless", [-inf, -inf, inf, inf]), ("short", [1.0, 2.0, 3.0]), ("far", [181.0, 0.0, 190.0, 1.0])]
    points = [(1, 0.0, 185.0), (2, 0.0, 179.5), (3, 0.0, -179.0), (4, 0.0, 178.9), (5, 3.0, 3.0), (6, 0.5, 0.5), (7, 0.0, -200.0), (8, 5.0, 180.0), (9, 5.0000001, 180.0), (10, 95.0, 20.0)]
    usable = [a for a in areas if a[0] not in ("nan", "short")]
    assert run(spark, points, [], areas) == brute(points, [], usable)


def test_long_edge_in_a_dense_block(spark):
    rnd = random.Random(7)
    points = [(k, 28.0 + rnd.uniform(0, 0.01), 85.0 + rnd.uniform(0, 0.01)) for k in range(3000)]
    shapes = [(1, "LINESTRING (84.5 27.5, 85.5 28.5)"), (2, "LINESTRING (85.005 27.5, 85.005 28.5)"), (3, "LINESTRING (84.5 28.005, 85.5 28.005)")]
    shapes += [(10 + k, f"POINT ({85 + rnd.uniform(0, 0.01)!r} {28 + rnd.uniform(0, 0.01)!r})") for k in range(50)]
    assert run(spark, points, shapes, []) == brute(points, shapes, [])


def test_many_repeated_points_in_one_block(spark):
    p = spark.range(300_000).selectExpr("id % 75000 as pid", "28.0 + (id % 75000) % 1000 * 1e-6 as lat", "85.0D as lon")
    g = spark.createDataFrame([(1, "LINESTRING (84.5 28.0, 85.5 28.0)")], "gid long, geom string")
    a = spark.createDataFrame([("a", [84.0, 27.0, 86.0, 29.0])], "name string, bbox array<double>")
    r = N.points_near(p, "pid", "lat", "lon", g, "gid", "geom", a, "name", "bbox")
    near = sum(75 for k in range(1000) if k * 1e-6 * 111320 <= 60)
    assert {(x["relation"], x["count"]) for x in r.groupBy("relation").count().collect()} == {("near", near), ("inside", 75_000)}
    assert r.distinct().count() == r.count()


@pytest.mark.parametrize("at_once", [10, 1_000_000])
def test_trapezoids_are_few_and_cover_the_interior(at_once):
    import numpy as np

    n = 400
    ring = [(math.cos(k / n * 6.283185) * (1 + 0.3 * (k % 2)), math.sin(k / n * 6.283185) * (1 + 0.3 * (k % 2))) for k in range(n)]
    x, y = (np.array([p[k] for p in ring]) for k in (0, 1))
    who, t = N._trapezoids(np.zeros(n, np.int64), x, y, np.roll(x, -1), np.roll(y, -1), at_once)
    area = ((t[:, 1] - t[:, 0]) * (t[:, 4] + t[:, 5] - t[:, 2] - t[:, 3]) / 2).sum()
    assert area == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2))
    if at_once > n:
        assert len(t) < 3 * n


def test_empty_tables(spark):
    points, shapes = scene(5, 30)
    assert run(spark, [], shapes, AREAS) == set()
    assert run(spark, points, [], AREAS) == brute(points, [], AREAS)
    assert run(spark, points, shapes, []) == brute(points, shapes, [])


def test_repeated_points_in_several_lots(spark, monkeypatch):
    monkeypatch.setattr(N, "LOT", 300)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        once = [(k, 28.0 + k % 7 * 1e-6, 85.0) for k in range(200)]
        points = once * 10 + [(900, 28.0, 85.0)] * 2000 + [(k, 28.0, 85.0) for k in range(1000, 1100)]
        shapes, areas = [(1, "POINT (85.0 28.0)"), (2, "LINESTRING (84.9999 28, 85.0001 28)")], [("a", [84.0, 27.0, 86.0, 29.0])]
        assert run(spark, points, shapes, areas) == brute([*once, (900, 28.0, 85.0), *points[-100:]], shapes, areas)
    finally:
        spark.conf.set(size, before)
