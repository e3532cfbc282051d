import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.operators import graph as G
from scarpline.operators import hydrology as H


def test_filling():
    z = np.array([[5, 5, 5, 5], [5, 1, 2, 5], [5, 2, 1, 4], [5, 5, 5, 5]], dtype=float)
    f = H.priority_flood(z)
    assert (f[1:3, 1:3] == 4).all() and (f >= z).all()
    hole = z.copy()
    hole[1, 2] = np.nan
    f = H.priority_flood(hole)
    assert np.isnan(f[1, 2]) and f[1, 1] == 1
    ramp = np.add.outer(np.arange(5.0), np.arange(6.0))
    assert (H.priority_flood(ramp) == ramp).all()


def test_every_cell_drains_after_filling():
    rng = np.random.default_rng(4)
    for _ in range(20):
        z = rng.integers(0, 5, (9, 11)).astype(float)
        f = H.priority_flood(z)
        code = H.drain_flats(f, H.d8(f))
        acc = H.accumulation(code)
        ends = 0
        for r in range(9):
            for c in range(11):
                y, x, n = r, c, 0
                while code[y, x] and n < 200:
                    dr, dc = C.D8[int(code[y, x])]
                    y, x, n = y + dr, x + dc, n + 1
                    if not (0 <= y < 9 and 0 <= x < 11):
                        break
                assert n < 200 and (not (0 <= y < 9 and 0 <= x < 11) or y in (0, 8) or x in (0, 10))
        ends = acc[code == 0].sum()
        assert ends == z.size


def test_directions_by_tiles_and_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    z = rng.random((23, 17))
    monkeypatch.setattr(H, "TILE", 5)
    d = spark.createDataFrame([("a", r, c, float(z[r, c])) for r in range(23) for c in range(17)], "area string, row int, col int, elev double")
    got = {(r.row, r.col): r.direction for r in H.flow_directions(d).collect()}
    code = H.d8(z)
    assert got == {(r, c): int(code[r, c]) for r in range(23) for c in range(17)}
    assert H.flow_directions(d.limit(0)).count() == 0


def test_nearest_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "SENT_NODES", 10)
    rnd = random.Random(6)
    nodes = [(k, rnd.choice("ab"), rnd.uniform(0, 3), rnd.uniform(0, 3)) for k in range(200)]
    points = [(k, rnd.choice("abc"), rnd.uniform(-1, 4), rnd.uniform(-1, 4)) for k in range(150)] + [(999, "a", None, 1.0)]
    n = spark.createDataFrame([*nodes, (500, "a", None, 1.0)], "node int, area string, lat double, lon double")
    p = spark.createDataFrame(points, "id int, area string, lat double, lon double")
    got = {r.id: r.node for r in H.nearest(p, n, "id", "node", "area").collect()}
    want = {}
    for i, a, y, x in points:
        own = [((y - v) ** 2 + (x - w) ** 2, k) for k, b, v, w in nodes if b == a] if y is not None else []
        if own:
            want[i] = min(own)[1]
    assert got == want


def test_walk_and_clip(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(8)], "node int, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 400.0), (1, 2, 400.0), (2, 3, 400.0), (5, 6, 100.0), (6, 5, 100.0), (7, None, 1.0)], "src int, dst int, dist double")
    starts = spark.createDataFrame([("a", 0), ("loop", 5), ("sink", 3), ("x", 7), ("none", None)], "k string, node int")
    d = H.downstream(starts, nodes, edges, "k", "node", 1.0)
    rows = sorted((r.k, r.seq, r.node, round(r.lat, 6), r.distance_km) for r in d.collect())
    assert rows == [("a", 0, 0, 0.0, 0.0), ("a", 1, 1, 1.0, 0.4), ("a", 2, 2, 2.0, 0.8), ("a", 3, None, 2.5, 1.0), ("loop", 0, 5, 5.0, 0.0), ("loop", 1, 6, 6.0, 0.1), ("sink", 0, 3, 3.0, 0.0), ("x", 0, 7, 7.0, 0.0)]
    assert not G.is_acyclic(edges) and G.is_acyclic(edges.where("src < 5"))


def test_linked_groups(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), (2, 1)] + [(k, k + 1) for k in range(100, 140)], "a int, b int")
    got = {r.node: r.label for r in G.linked_groups(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | {k: 100 for k in range(100, 141)}
    assert G.linked_groups(e.limit(0)).count() == 0


def test_lookup_terrain(spark):
    nodes = spark.createDataFrame([(1, "a", 27.0, 85.0, 12.5)], "node int, area string, lat double, lon double, upstream_area_km2 double")
    dem = spark.createDataFrame([("a", r, c, float(r * c)) for r in range(5) for c in range(5)], "area string, row int, col int, elev double")
    areas = spark.createDataFrame([("a", 500.0), ("b", 350.0)], "name string, local_relief_fallback_m double")
    p = spark.createDataFrame([("in", "a", 27.01, 85.0, 2, 2), ("out", "a", 27.0, 85.0, 90, 90)], "id string, area string, lat double, lon double, row int, col int")
    got = {r.id: r for r in H.lookup_terrain(p, nodes, dem, areas, "id", "node", 1).collect()}
    assert (got["in"].local_relief_m, got["in"].local_relief_is_real, got["in"].upstream_area_km2) == (8.0, True, 12.5)
    assert (got["out"].local_relief_m, got["out"].local_relief_is_real) == (500.0, False)
    assert got["in"].distance_to_channel_km == pytest.approx(1.1132)
    assert spark.range(1).select(H.half_window(F.lit(33.396)).alias("h")).first().h == 15


def test_walks_start_from_every_node(spark, data):
    from scarpline.plans import terrain
    from scarpline.plans import views as V

    nodes, edges = V.forest(spark, data)
    at = {r.node: (r.lat, r.lon) for r in nodes.collect()}
    down = {r.src: (r.dst, r.dist) for r in edges.collect()}
    walked, clipped = set(), set()
    for start in at:
        node, seq, dist, cut = start, 0, 0.0, False
        walked.add((start, 0, node, 0.0))
        clipped.add((start, 0, node, *at[node], 0.0))
        while node in down:
            last, before = node, dist
            node, seq, dist = down[node][0], seq + 1, dist + down[node][1]
            walked.add((start, seq, node, dist))
            if not cut and node in at:
                f = min(1.0, (250 - before) / (dist - before))
                cut = dist >= 250
                clipped.add((start, seq, node if dist <= 250 else None, *(a + f * (b - a) for a, b in zip(at[last], at[node])), min(dist, 250.0) / 1000))
    got = [tuple(r) for r in terrain.downstream_walk(spark, data).collect()]
    assert len(got) == len(walked) and set(got) == walked and {r[0] for r in got} == set(at)
    flat = lambda rows: sorted((s, k, -1 if n is None else n, *(round(x, 5) + 0.0 for x in v)) for s, k, n, *v in rows)
    near = lambda a, b: a[:3] == b[:3] and all(abs(x - y) < 2.1e-5 for x, y in zip(a[3:], b[3:]))
    a, b = flat(clipped), flat(tuple(r) for r in terrain.downstream_clip(spark, data).collect())
    assert len(a) == len(b) and all(map(near, a, b))
