import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import raster as R
from scarpline.operators.detect import predict_floods, predict_slides


def grid(text):
    return np.array([[c == "#" for c in row] for row in text.split()])


def brute_components(m, diagonal):
    left = {tuple(p) for p in np.argwhere(m)}
    n = 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            r, c = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (diagonal or not (a and b)) and (r + a, c + b) in left:
                        left.discard((r + a, c + b))
                        todo.append((r + a, c + b))
    return n


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_like_flood_fill(diagonal):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.5, 0.7, 1.0):
        for _ in range(20):
            m = rng.random((9, 13)) < share
            label, n = R.components(m, diagonal)
            assert n == brute_components(m, diagonal) and ((label > 0) == m).all()


def test_borders():
    square = grid("..... .###. .###. .###. .....")
    (ring,) = R.borders(square)
    assert len(ring) == 8 and R.ring_area(R.corners_only(ring)) == 4.0 and R.ring_length(ring) == 8.0
    assert sorted(map(tuple, R.corners_only(ring))) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    donut = grid("####### #.....# #.....# #.....# #######")
    assert len(R.borders(donut)) == 2 and len(R.borders(donut, True)) == 1
    two = grid("#... .#.. ....")
    assert len(R.borders(two)) == 1 and R.components(two)[1] == 2  # borders are 8-connected, components 4-connected
    assert R.borders(np.zeros((3, 3), bool)) == [] and len(R.borders(grid("#"))) == 1


def test_borders_surround_their_components():
    rng = np.random.default_rng(2)
    for _ in range(30):
        m = rng.random((10, 10)) < 0.45
        outer = R.borders(m, True)
        assert len(outer) == brute_components(m, True)
        inside = np.zeros_like(m)
        for ring in outer:
            inside |= R.filled(ring, m.shape)
        assert (inside | ~m).all()


def test_polygons():
    big = np.zeros((40, 40), bool)
    big[5:25, 5:30] = True
    big[10:15, 10:15] = False
    big[35, 35] = True
    w = np.where(big, 0.5, -0.25)
    found = R.polygons_of(big, w)
    assert len(found) == 2 and sorted(len(p["mask_polygon"]) for p in found)[0] == 4
    outer = max(found, key=lambda p: len({(c["x"], c["y"]) for c in p["mask_polygon"]}) and R.ring_area(np.array([(c["x"], c["y"]) for c in p["mask_polygon"]])))
    assert outer["confidence"] == round(w[5:25, 5:30].mean(), 4)
    assert len(R.polygons_of(big, None, True)) == 1 and R.polygons_of(np.zeros((4, 4), bool)) == []
    line = np.array([(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2)], dtype=float)
    assert len(R.simplified(line, 0.05)) == 4 and len(R.simplified(line, 0.0)) == 5


@pytest.mark.parametrize("b, expected", [([(0, 0), (10, 0), (10, 10), (0, 10)], 1.0), ([(20, 20), (30, 20), (30, 30), (20, 30)], 0.0), ([(5, 0), (15, 0), (15, 10), (5, 10)], 50 / 150), ([(0, 0), (1, 1)], 0.0)])
def test_iou(b, expected):
    a = [np.array([(0, 0), (10, 0), (10, 10), (0, 10)], dtype=float)]
    assert R.iou(a, [np.array(b, dtype=float)]) == pytest.approx(expected, abs=1e-12)
    assert R.iou([], a) == 0.0


def test_overlap_like_counted_points():
    rng = np.random.default_rng(9)
    n = 400
    xs, ys = (np.arange(n) + 0.5) / n, ((np.arange(n) + 0.5) / n)[:, None]
    for _ in range(15):
        a, b = ([rng.random((int(rng.integers(3, 7)), 2)) for _ in range(2)] for _ in range(2))
        one, two = (np.logical_or.reduce([R.inside_even_odd(xs[None, :], ys, p) for p in s]) for s in (a, b))
        both, either = R.overlap_areas(a, b)
        assert both == pytest.approx((one & two).mean(), abs=0.01) and either == pytest.approx((one | two).mean(), abs=0.01)


def test_representative_point():
    u = np.array([(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)], dtype=float)
    for ring in (u, u[::-1], np.array([(0, 0), (4, 0), (0, 3)], dtype=float)):
        x, y = R.representative_point(ring)
        assert R.inside_even_odd(np.array([x]), np.array([y]), ring)[0]


def test_perceptual_hash():
    rng = np.random.default_rng(3)
    a = np.kron(rng.random((8, 8)), np.ones((16, 16)))
    h = R.perceptual_hash(a)
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(h, R.perceptual_hash(a + rng.normal(0, 0.01, a.shape))) <= 5
    assert bits(h, R.perceptual_hash(a[::2, ::2])) <= 5 and bits(h, R.perceptual_hash(rng.random((128, 128)))) > 15
    assert R.perceptual_hash(np.zeros((0, 0))) is None


def test_pixel_tables(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 0.4, 0.1), (2, 0, 0, None, 0.1), (2, 0, 1, 0.2, 0.3)], "chip int, row int, col int, green double, nir double")
    s = {r.chip: r for r in R.chip_stats(d, "chip").collect()}
    assert (s[1].pixels, s[1].water_pixels) == (2, 1) and (s[2].pixels, s[2].water_pixels) == (1, 0)
    assert R.chip_stats(d.limit(0), "chip").count() == 0
    v = d.select("chip", "row", "col", F.when(F.col("col") == 0, float("nan")).otherwise(F.col("green")).alias("v"))
    assert {r.stretched for r in R.percentile_stretch(v, ["chip"], "v", True).collect()} == {0}
    masks = spark.createDataFrame([("a", r, c, 255 if (r, c) in ((1, 1), (2, 2)) else 0) for r in range(4) for c in range(4)], "chip string, row int, col int, value int")
    assert R.component_counts(masks, "chip").first().n_components == 2 and R.component_counts(masks, "chip", diagonal=True).first().n_components == 1
    audit = R.mask_audit(masks, "chip", 4, 4).first()
    assert (audit.positive_pixels, audit.foreground_frac, audit.touches_border) == (2, 0.125, False)
    assert R.mask_polygons(masks, "chip").first().polygons == []


def test_detectors(spark):
    images = spark.createDataFrame([("x", 2, 4, [[1.0] * 8, [2.0] * 8, [3.0] * 8])], "id string, height int, width int, bands array<array<double>>")
    (d,) = predict_slides(images, "id").first().detections
    assert set(d.asDict()) == {"mask_polygon", "confidence", "class"} and d.confidence == 0.87 and len(d.mask_polygon) == 6
    assert predict_slides(images, "id").first() == predict_slides(images, "id").first()

    def factory():
        def detector(bands):
            assert bands[0, 0, 0] == 3.0  # blue first
            tri = [(0, 0), (1.26, 0), (1, 1)]
            return [{"mask_polygon": tri, "confidence": 0.40678, "class": "landslide"}, {"mask_polygon": tri, "confidence": 0.2, "class": "landslide"}, {"mask_polygon": tri[:2], "confidence": 0.9, "class": "landslide"}]

        return detector

    (d,) = predict_slides(images, "id", factory).first().detections
    assert d.confidence == 0.4068 and d.mask_polygon[1].x == 1.3
    g, n = [0.5] * 100, [0.1] * 100
    rasters = spark.createDataFrame([("tif", "a.TIF", 10, 10, [g, g, n, n]), ("png", "a.png", 10, 10, [g, g, n, n]), ("few", "a.tif", 10, 10, [g]), ("none", None, None, None, None)], "id string, path string, height int, width int, bands array<array<double>>")
    assert {r.id: len(r.detections) for r in predict_floods(rasters, "id").collect()} == {"tif": 1, "png": 0, "few": 0, "none": 0}
