import json
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import catalog as K
from scarpline.operators import exposure as X
from scarpline.operators import hygiene as Y
from scarpline.operators import registry as A
from scarpline.operators.detect import predict_floods
from scarpline.operators.pipelines import propagate_exposure, run_cases
from scarpline.sources import files, geotiff
from scarpline.streaming import scars as stream


def test_line_reference(spark):
    path = spark.createDataFrame([("w", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1000.0, 0.0), (1000.0, 2000.0)])] + [("one", 0, 0.0, 0.0)], "way string, seq int, x double, y double")
    assert X.segments(path, "way").count() == 2
    pieces = spark.createDataFrame(
        [(1, 500.0, 300.0, 500.0, 300.0), (2, 5000.0, 0.0, 5000.0, 0.0), (3, 900.0, -500.0, 1500.0, 100.0), (4, 1000.0, 3000.0, 1000.0, 3000.0), (5, 900.0, 500.0, 1100.0, 700.0), (6, 900.0, 800.0, 900.0, 800.0)], "id int, ax double, ay double, bx double, by double"
    )
    got = {r.id: (round(r.lateral_m, 3), round(r.along_m, 3)) for r in X.line_reference(X.segments(path, "way"), pieces, "way", "id").collect()}
    assert got == {1: (300.0, 500.0), 3: (round(400 / 2**0.5, 3), 1000.0), 4: (1000.0, 3000.0), 5: (0.0, 1600.0), 6: (100.0, 1800.0)}


def test_exposure_ranks(spark):
    d = spark.createDataFrame([("s", 1, "Old bridge", "bridge", 10.0, 2000.0), ("s", 2, "House", "building", 10.0, 2000.0), ("s", 3, "House", "building", 5.0, 2001.0), ("s", 4, "?", "mystery_type", 10.0, 100.0)], "k string, id int, name string, asset_type string, lateral_m double, along_m double")
    e = X.exposure(d, "k", "id", F.lit(1.0))
    assert {r.id for r in e.collect()} == {1, 2, 4}
    r = X.rank_assets(e, "k", "id").orderBy("rank").collect()
    assert [(x.id, x.weight) for x in r] == [(1, 0.95), (4, 0.5), (2, 0.5)] and r[0].risk_score == round(r[0].exposure_score * 0.95, 4)
    assert X.exposure(d, "k", "id", F.lit(1.0), rows=1).count() == 1
    with pytest.raises(ValueError):
        X.assets()


def test_propagated_exposure(spark):
    nodes = spark.createDataFrame([(k, 28.0 - k * 0.005, 85.2) for k in range(4)], "node int, lat double, lon double")
    edges = spark.createDataFrame([(k, k + 1, 555.0) for k in range(3)], "src int, dst int, dist double")
    scars = spark.createDataFrame([("a", 0, "breach_risk", "EPSG:32645"), ("end", 3, "stable", "EPSG:32645")], "scar_id string, node int, verdict string, utm_crs string")
    from scarpline.functions.geodesy import to_utm

    spots = spark.createDataFrame([(7, 27.992, 85.205, "School", "school"), (8, 27.992, 85.3, "Far", "school")], "asset_id int, lat double, lon double, name string, asset_type string")
    u = spots.withColumn("u", to_utm("lat", "lon", F.lit("EPSG:32645")))
    pieces = u.select("asset_id", *[F.col(f"u.{c[-1]}").alias(c) for c in ("ax", "ay", "bx", "by")])
    (r,) = propagate_exposure(scars, nodes, edges, pieces, spots).collect()
    assert (r.scar_id, r.asset_id, r.rank) == ("a", 7, 1) and 0.85 < r.distance_km < 0.92 and 0.45 < r.lateral_offset_km < 0.55


def test_cases(spark):
    tri = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    kind = "case string, detections array<struct<mask_polygon:array<struct<x:double,y:double>>,confidence:double,class:string>>"
    cases = spark.createDataFrame([("both", 250.0, None), ("weak", 1.0, 5.0), ("none", 1.0, 5.0)], "case string, upstream_area_km2 double, local_relief_m double")
    found = spark.createDataFrame([("both", [(tri, 0.5, "landslide"), (tri[:2], 0.9, "landslide")]), ("weak", [(tri, 0.02, "landslide")]), ("none", [])], kind)
    floods = spark.createDataFrame([("both", [(tri, 0.3, "flood")]), ("weak", [])], kind)
    got = {r.case: r for r in run_cases(cases, found, floods).collect()}
    assert (got["both"].level, got["both"].n_scars, got["both"].n_floods) == (0.25, 1, 1) and got["both"].iou == pytest.approx(1.0)
    assert (got["weak"].level, got["weak"].n_detections, got["weak"].n_scars, got["weak"].iou) == (0.01, 1, 0, None)
    assert (got["none"].level, got["none"].n_detections, got["none"].n_scars) == (None, 0, 0)


def test_hash_pairs_like_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    flip = lambda h, n: int(np.int64(h) ^ np.bitwise_xor.reduce(np.array([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, False)] or [0], dtype=np.uint64)).astype(np.int64))
    rows = [(k, flip(base[k % 30], k % 8)) for k in range(200)] + [(900, None), (901, None)]
    got = {(r.a, r.b) for r in Y.hash_pairs(spark.createDataFrame(rows, "id int, h long"), "id", "h").collect()}
    want = {(i, j) for i, h in rows for j, g in rows if i < j and h is not None and g is not None and bin((h ^ g) & (2**64 - 1)).count("1") <= 5}
    assert got == want


def test_near_hashes(spark):
    rnd = random.Random(6)
    base = [rnd.randrange(-(2**63), 2**63) for _ in range(20)] + [0, -1, 2**63 - 1, -(2**63)]

    def flip(h, n):
        for b in rnd.sample(range(64), n):
            h ^= 1 << b
        h &= 2**64 - 1
        return h - 2**64 if h >= 2**63 else h

    left, right = [flip(b, k % 4) for b in base for k in range(4)] + [None], [flip(b, k) for b in base for k in range(7)] + [None]
    got = {tuple(r) for r in Y.near_hashes(spark.createDataFrame([(h,) for h in left], "h long"), spark.createDataFrame([(h,) for h in right], "h long")).collect()}
    assert got == {(g, h) for g in left for h in right if g is not None and h is not None and bin((g ^ h) & (2**64 - 1)).count("1") <= 5}


def test_greedy_split_like_the_plain_loop(spark):
    sizes = [49, 31, 19, 19, 5, 5, 5] + [3] * 300 + [2] * 40 + [1] * 700
    groups = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    got = {r.group_id: r.split for r in Y.greedy_split(spark.createDataFrame(groups, "group_id int, item int")).collect()}
    targets, have, total = {"train": Fraction(230, 275), "validation": Fraction(35, 275), "test": Fraction(10, 275)}, {"train": 0, "validation": 0, "test": 0}, 0
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
        s = max(targets, key=lambda k: targets[k] - (Fraction(have[k], total) if total else 0))
        assert got[g] == s
        have[s] += sizes[g]
        total += sizes[g]


def test_catalogs(spark):
    c = spark.createDataFrame([("x", 10.0), ("x", 10.0), ("y", 10.0), ("y", 20.0), ("z", None)], "k string, gsd_m_per_px double")
    got = {r.k: (r.gsd_m_per_px, r.agree) for r in K.config_agreement(c, ["k"]).collect()}
    assert got == {"x": (10.0, True), "y": (None, False), "z": (10.0, True)}
    with pytest.raises(Exception, match="disagree"):
        K.config_agreement(c, ["k"], strict=True).collect()
    m = spark.createDataFrame([("r", 1, 0.2), ("r", 2, 0.3), ("r", 3, 0.3), ("r", 4, 0.1)], "run string, epoch int, m double")
    assert tuple(K.best_epoch(m, "run", "epoch", "m").first()) == ("r", 2, 0.3, 4)
    assert [r.since for r in K.best_so_far(m, "run", "epoch", "m").orderBy("epoch").collect()] == [0, 0, 1, 2]
    r = spark.range(1).select(K.first_available(F.array(F.lit(None).cast("string"), F.lit("b"))).alias("a"), K.first_available(F.array(F.lit(None).cast("string"))).alias("b")).first()
    assert (r.a, r.b) == ("b", None)


def test_registry(spark, monkeypatch):
    a = spark.createDataFrame([("sunkoshi", [85.55, 27.65, 86.05, 27.95]), ("trishuli", [84.5, 27.5, 85.6, 28.5])], "name string, bbox array<double>")
    p = spark.createDataFrame([(1, 27.8, 85.8), (2, 0.0, 0.0), (3, None, None), (4, 27.8, 85.57), (5, 28.5, 84.5)], "id int, lat double, lon double")
    want = {1: "sunkoshi", 2: None, 3: None, 4: "sunkoshi", 5: "trishuli"}
    assert {r.id: r.area for r in A.locate(p, a, "id").collect()} == want
    monkeypatch.setattr(A, "SENT_AREAS", 1)
    assert {r.id: r.area for r in A.locate(p, a, "id").collect()} == want
    assert A.area_config(a, "trishuli")["bbox"][0] == 84.5
    with pytest.raises(KeyError):
        A.area_config(a, "nowhere")


def test_geotiff(spark, tmp_path):
    rng = np.random.default_rng(8)
    for k, dtype in enumerate(("u1", "i2", "f4", "f8")):
        b = (rng.random((4, 6, 5)) * 200).astype(dtype)
        (tmp_path / f"{k}.tif").write_bytes(geotiff.write_geotiff(b, [0.1, 0, 85.0, 0, -0.2, 28.0], 4326 if k % 2 else 32645, compress=bool(k % 2)))
    (tmp_path / "note.txt").write_text("no raster")
    rows = sorted(geotiff.read(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert [r.crs for r in rows] == ["EPSG:32645", "EPSG:4326"] * 2 and all((r.width, r.height, r["count"]) == (5, 6, 4) and r.transform == [0.1, 0.0, 85.0, 0.0, -0.2, 28.0] for r in rows)
    assert rows[3].bands[2] == pytest.approx(b[2].ravel().tolist())
    g = np.zeros((4, 10, 10), np.float32)
    g[1], g[3] = 0.5, 0.1
    (tmp_path / "water.tif").write_bytes(geotiff.write_geotiff(g))
    (tmp_path / "few.tif").write_bytes(geotiff.write_geotiff(g[:1]))
    r = geotiff.read(spark, str(tmp_path / "[wf]*.tif"))
    assert {os.path.basename(x.path): len(x.detections) for x in predict_floods(r.withColumn("id", F.col("path")), "id").withColumnRenamed("id", "path").collect()} == {"water.tif": 1, "few.tif": 0}
    assert geotiff.read(spark, str(tmp_path / "no*.tif")).count() == 0


def test_files(spark, tmp_path):
    for n, box in (("b", [1.0, 2.0, 3.0, 4.0]), ("a", [5.0, 6.0, 7.0, 8.0])):
        (tmp_path / "areas" / n).mkdir(parents=True)
        (tmp_path / "areas" / n / "config.json").write_text(json.dumps({"display_name": n.upper(), "bbox": box, "utm_crs": "EPSG:32645", "local_relief_fallback_m": 500.0}, indent=1))
        (tmp_path / "sets" / n).mkdir(parents=True)
        (tmp_path / "sets" / n / "dataset_config.json").write_text(json.dumps({"gsd_m_per_px": 10.0, "more": {"x": 1}}))
    areas = files.study_areas(spark, str(tmp_path / "areas"))
    assert [r.name for r in A.list_areas(areas).collect()] == ["a", "b"] and areas.where("name = 'a'").first().bbox == [5.0, 6.0, 7.0, 8.0]
    sets = files.dataset_configs(spark, str(tmp_path / "sets"))
    assert sets.select(F.variant_get("every", "$.more.x", "int").alias("x")).first().x == 1
    models = K.model_configs(sets.select("dataset", "gsd_m_per_px"), spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "gone")], "model string, dataset string"))
    files.write_configs(models, str(tmp_path / "models"))
    assert K.gsd_of(models).first().gsd_m_per_px == 10.0 and json.loads(spark.read.text(str(tmp_path / "models")).first().value)["sources"][1]["dataset"] == "b"

    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "x", "highway": "path"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    g = files.geojson(spark, str(tmp_path / "r.geojson"))
    r = g.first()
    assert (r.name, r.highway, r.bridge) == ("x", "path", None) and json.loads(r.geometry)["coordinates"] == [1, 2]
    files.write_geojson(g, str(tmp_path / "out"), ["name", "highway", "nothing"])
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["properties"] == {"name": "x", "highway": "path"}

    labels = spark.createDataFrame([("train", "i1", 0, 0, [0.5, 0.25]), ("train", "i1", 1, 2, [1.0, 0.0]), ("val", "i2", 0, 0, [0.1, 0.2])], "split string, stem string, at int, label int, flat array<double>")
    files.write_labels(labels, str(tmp_path / "labels"))
    assert {r.value for r in spark.read.text(str(tmp_path / "labels")).collect()} == {"0 0.500000 0.250000", "2 1.000000 0.000000", "0 0.100000 0.200000"}
    (tmp_path / "one.txt").write_text("0 0.5 0.25\n\n1 0.1 0.2 0.3 0.4\n")
    assert [(r.at, r.label, r.flat) for r in files.label_files(spark, str(tmp_path / "one.txt")).orderBy("at").collect()] == [(0, 0, [0.5, 0.25]), (1, 1, [0.1, 0.2, 0.3, 0.4])]

    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "results.csv").write_text("epoch,time,metrics/mAP50(M)\n1,5.8,0.1\n2,9.2,0.3\n")
    m = files.training_metrics(spark, str(tmp_path / "runs"))
    assert K.best_epoch(m, "run", "epoch", "`metrics/mAP50(M)`").first().best_epoch == 2
    (tmp_path / "a.tif.aux.xml").write_text('<PAMDataset><PAMRasterBand band="1"><Metadata><MDI key="STATISTICS_MAXIMUM">9</MDI><MDI key="STATISTICS_MEAN">4.5</MDI></Metadata></PAMRasterBand><PAMRasterBand band="2"><Metadata><MDI key="STATISTICS_MAXIMUM">7</MDI></Metadata></PAMRasterBand></PAMDataset>')
    assert {(r.band, r.maximum, r.mean) for r in files.band_statistics(spark, str(tmp_path / "a.tif.aux.xml")).collect()} == {(1, 9.0, 4.5), (2, 7.0, None)}
    assert files.listing(spark, str(tmp_path / "runs")).count() == 1 and "nc: 1" in files.data_yaml("x")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i, t, a: json.dumps({"scar_id": i, "seen_at": t, "area_m2": a, "upstream_area_km2": 250.0, "local_relief_m": None})
    (folder / "1.json").write_text("\n".join([row("a", "2024-01-01T00:10:00", 2e5), row("b", "2024-01-01T00:20:00", -1.0), row("a", "2024-01-01T00:10:00", 2e5)]))
    q = stream.write(stream.assessed(stream.landing(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "c1"), once=True)
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and {(r.scar_id, r.verdict) for r in got.collect()} == {("a", "breach_risk"), ("b", None)}
    q = stream.write(stream.verdicts_by_hour(stream.landing(spark, str(folder))), str(tmp_path / "hours"), str(tmp_path / "c2"), once=True)
    assert q.awaitTermination(120)
    (folder / "2.json").write_text("\n".join([row("c", "2024-01-01T06:00:00", 2e5), row("late", "2023-12-31T00:00:00", 2e5)]))
    for _ in range(2):
        q = stream.write(stream.verdicts_by_hour(stream.landing(spark, str(folder))), str(tmp_path / "hours"), str(tmp_path / "c2"), once=True)
        assert q.awaitTermination(120)
    hours = {(str(r.hour), r.verdict): r.scars for r in spark.read.parquet(str(tmp_path / "hours")).collect()}
    assert hours[("2024-01-01 00:00:00", "breach_risk")] == 1


def test_crosscheck_leaves_no_lookup_out(spark, data):
    from scarpline.plans import regions
    from scarpline.plans import views as V

    n = V.lookups(spark, data).count()
    half = V.lookups(spark, data).where("(lat is null) <> (lon is null)").select("lookup_id").collect()
    states = {r.lookup_id: r.state for r in regions.location_crosscheck(spark, data).collect()}
    assert len(states) == n and half and {states[r.lookup_id] for r in half} == {"none"}
    counts = {r.state: r for r in regions.location_crosscheck_geodesic(spark, data).collect()}
    assert sum(r.n for r in counts.values()) == n and counts["none"].mean_km is None
    assert counts["none"].n == sum(s == "none" for s in states.values()) and counts["outside"].n == sum(s == "outside" for s in states.values())


def test_crosscheck_of_strange_coordinates(spark):
    from scarpline.operators.registry import crosscheck

    areas = spark.createDataFrame([("a", [84.0, 27.0, 86.0, 29.0])], "name string, bbox array<double>")
    rows = [(1, None, None), (2, 28.0, None), (3, None, 85.0), (4, 95.0, 28.0), (5, 85.0, 28.0), (6, 28.0, 85.0)]
    u = spark.createDataFrame([(k, y, x, "a", y, x) if k < 6 else (k, y, x, "a", y + 0.004, x) for k, y, x in rows], "k int, embedded_lat double, embedded_lon double, region string, lat double, lon double")
    got = {r.k: r for r in crosscheck(u, areas, "k").collect()}
    assert [got[k].state for k in range(1, 7)] == ["none"] * 3 + ["outside"] * 2 + ["confirmed"]
    assert [got[k].distance_km for k in range(1, 5)] == [None] * 4 and abs(got[5].distance_km) < 1e-9 and abs(got[6].distance_km - 0.44327) < 1e-4


def png(gray, width):
    import struct
    import zlib

    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = b"".join(b"\0" + bytes(v for p in gray[k : k + width] for v in p) for k in range(0, len(gray), width))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, len(gray) // width, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12), (13, 14, 15), (16, 17, 18)], 3))
    (tmp_path / "b.png").write_bytes(b"no image")
    (r,) = files.images(spark, str(tmp_path)).collect()
    assert (r.height, r.width, os.path.basename(r.path)) == (2, 3, "a.png") and r.bands == [[1.0, 4.0, 7.0, 10.0, 13.0, 16.0], [2.0, 5.0, 8.0, 11.0, 14.0, 17.0], [3.0, 6.0, 9.0, 12.0, 15.0, 18.0]]


def test_grid_to_graph_to_assets(spark, tmp_path):
    """A raster file to cells, channels, a graph on disk, a walk and ranked assets of WKT and GeoJSON."""
    from scarpline.operators import hydrology as H
    from scarpline.operators import raster as R

    z = np.add.outer(np.arange(40) * -2.0, np.abs(np.arange(30) - 15) * 5.0).astype("f4") + 500
    grid = [0.001, 0.0, 85.0, 0.0, -0.001, 28.0]
    (tmp_path / "a.tif").write_bytes(geotiff.write_geotiff(z[None], grid, 4326))
    raster = geotiff.read(spark, str(tmp_path)).withColumn("area", F.lit("a"))
    dem, grids = R.cells(raster, "area"), raster.select("area", "transform", "width", "height")
    assert dem.count() == 1200 and R.cells(raster, "area", 2).count() == 0
    nodes, edges = H.drainage_graph(dem, grids, threshold=100)
    files.write_graph(nodes, edges, str(tmp_path / "graph"))
    nodes, edges = files.read_graph(spark, str(tmp_path / "graph"))
    n = {r.node: r for r in nodes.collect()}
    assert len(n) > 20 and {r.col for r in n.values()} == {15} and len(n) - 1 == edges.count()
    first = min(n.values(), key=lambda r: r.row)
    assert first.lon == pytest.approx(85.0155) and first.lat == pytest.approx(28.0 - 0.001 * (first.row + 0.5))
    area = 0.001 * 111320 * np.cos(np.radians(27.98)) * 111.32 / 1e6
    assert first.upstream_area_km2 == pytest.approx(first.accumulation * area)
    s = H.graph_summary(nodes, edges).first()
    assert (s.n_nodes, s.n_edges) == (len(n), len(n) - 1) and s.max_upstream_area_km2 == max(r.upstream_area_km2 for r in n.values())
    tiff = geotiff.read_geotiff(bytes(H.channel_masks(nodes, grids).first().tiff))
    assert tiff["bands"].sum() == len(n) and tiff["bands"][0, first.row, first.col] == 1
    p = H.rows_and_cols(spark.createDataFrame([("in", "a", 27.9896, 85.0144), ("out", "a", 29.0, 85.0)], "k string, area string, lat double, lon double"), grids)
    at = {r.k: r for r in p.collect()}
    assert (at["in"].row, at["in"].col, at["in"].half, at["out"].row) == (10, 14, 4, None)
    areas = spark.createDataFrame([("a", 300.0, [85.0, 27.9, 85.03, 28.0])], "name string, local_relief_fallback_m double, bbox array<double>")
    t = {r.k: r for r in H.lookup_terrain(p, nodes, dem, areas, "k", "node", F.col("half")).collect()}
    assert t["in"].local_relief_is_real and t["in"].local_relief_m == float(z[6:15, 10:19].max() - z[6:15, 10:19].min()) and t["out"].local_relief_m == 300.0
    things = spark.createDataFrame([(1, "a", "Bridge", "bridge", "LINESTRING (85.0 27.975, 85.03 27.975)"), (2, "a", "Hut", "building", '{"type":"Polygon","coordinates":[[[85.02,27.97],[85.021,27.97],[85.021,27.971],[85.02,27.97]]]}'), (3, "a", "Far", "school", "POINT (86 28)"), (4, "a", "?", "school", "POINT EMPTY")], "asset_id int, area string, name string, asset_type string, geometry string")
    from scarpline.operators import exposure as E

    assert {r.asset_id for r in E.clipped(things, areas, "asset_id").collect()} == {1, 2}
    spots = {r.asset_id: (round(r.lat, 4), round(r.lon, 4)) for r in E.representative_points(things, "asset_id").collect()}
    assert spots[3] == (28.0, 86.0) and spots[2] == (27.9703, 85.0207) and set(spots) == {1, 2, 3}
    zones = spark.createDataFrame([("a", "EPSG:32645")], "area string, crs string")
    pieces = E.pieces(things, "asset_id", "crs", zones=zones)
    assert pieces.count() == 1 + 3 + 1
    scars = spark.createDataFrame([("s", first.node, "breach_risk", "EPSG:32645")], "scar_id string, node string, verdict string, utm_crs string")
    got = {r.asset_id: r for r in propagate_exposure(scars, nodes, edges, pieces, things).collect()}
    assert set(got) == {1, 2} and got[1].lateral_offset_km == 0.0 and 0.4 < got[2].lateral_offset_km < 0.5 and got[1].rank == 1


def test_nearest_with_far_points(spark, monkeypatch):
    from scarpline.operators import hydrology as H

    monkeypatch.setattr(H, "SENT_NODES", 5)
    rnd = random.Random(3)
    nodes = [(k, rnd.choice("ab"), 28 + rnd.uniform(0, 0.2), 85 + rnd.uniform(0, 0.2)) for k in range(300)] + [(1000, "a", 40.0, 85.0)]
    points = [(k, rnd.choice("abc"), 28 + rnd.uniform(-0.3, 0.5), 85 + rnd.uniform(-0.3, 0.5)) for k in range(60)] + [(900, "a", -60.0, -170.0), (901, "b", 60.0, 170.0), (902, "b", None, 1.0), (903, "a", 39.9, 85.2)]
    n, p = spark.createDataFrame(nodes, "node int, area string, lat double, lon double"), spark.createDataFrame(points, "id int, area string, lat double, lon double")
    d = lambda p, n: (p[2] - n[2]) ** 2 + (p[3] - n[3]) ** 2
    for area in (None, "area"):
        want = {p[0]: min((d(p, n), n[0]) for n in nodes if area is None or n[1] == p[1])[1] for p in points if p[2] is not None and (area is None or p[1] != "c")}
        assert {r.id: r.node for r in H.nearest(p, n, "id", "node", area).collect()} == want


def test_pools_samples_and_texts(spark):
    from scarpline.functions.texts import literal_list, percent

    a, b = spark.createDataFrame([(k, "t" if k % 3 else "v") for k in range(30)], "id int, s string"), spark.createDataFrame([(7,)], "id int")
    u = Y.tagged_union({"x": a, "y": b})
    assert {(r.pool, r["count"]) for r in u.groupBy("pool").count().collect()} == {("x", 30), ("y", 1)}
    with pytest.raises(ValueError):
        Y.tagged_union({})
    one = [r.id for r in Y.sample_each(a, "id", "s", 4).collect()]
    assert len(one) == 8 and sorted(one) == sorted(r.id for r in Y.sample_each(a.orderBy("id"), "id", "s", 4).collect()) and sorted(one) != sorted(r.id for r in Y.sample_each(a, "id", "s", 4, seed=1).collect())
    m = spark.createDataFrame([("t", {"a": 1, "b": 2}), ("v", {}), ("w", None)], "split string, items map<string, int>")
    assert {tuple(r) for r in Y.flattened(m).collect()} == {("t", "a"), ("t", "b")}
    t = spark.createDataFrame([("(1, 2.5)",), ("[3,]",), ("[]",), ("os.remove(1)",), (None,)], "t string").select(literal_list("t").alias("v"))
    assert [r.v for r in t.collect()] == [[1.0, 2.5], [3.0], [], None, None]
    r = spark.range(1).select(percent(F.lit(1), F.lit(3)).alias("a"), percent(F.lit(0), F.lit(0)).alias("b")).first()
    assert (r.a, r.b) == ("1/3 (33.3%)", "0/0 (0.0%)")
    e = files.example_table(spark, [("c1", 28.1, 85.2, 22600, 1)], "chips/").first()
    assert e.image_path == "chips/c1.tif"


def test_skipped_detections(spark):
    from scarpline.operators import scars as S

    d = spark.createDataFrame([("a", [([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],), ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],), ([(0.0, 0.0)],), (None,)]), ("b", []), ("c", None)], "stem string, detections array<struct<mask_polygon:array<struct<x:double,y:double>>>>")
    assert {r.stem: r.n_skipped for r in S.skipped(d).collect()} == {"a": 3, "b": 0, "c": 0}


def test_perceptual_hash_keeps_bytes():
    from scarpline.operators.raster import _resized, perceptual_hash

    flat = np.full((50, 40), 77.0)
    assert (_resized(flat, 32) == 77).all() and _resized(flat, 32).shape == (32, 40)
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, (32, 32)).astype(float)
    assert (_resized(same, 32) == same).all()  # nothing to resize, nothing changed
    big = np.kron(same, np.ones((4, 4)))
    bits = lambda a, b: bin((perceptual_hash(a) ^ perceptual_hash(b)) & (2**64 - 1)).count("1")
    assert bits(same, big) <= 8 and bits(big, np.clip(big * 0.9 + 5, 0, 255)) <= 5 and perceptual_hash(np.zeros((0, 3))) is None
