import math

import pytest
from pyspark.sql import functions as F

from scarpline.functions import bands as B
from scarpline.functions import geodesy as D
from scarpline.functions import physics as P
from scarpline.functions import polygon as G
from scarpline.functions import texts as X
from scarpline.functions.geotext import LINE, POINT, RING, read_geometry


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit_poly(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points]) if points else F.array().cast(G.POLYGON)


def test_physics_worked_example(spark):
    v, h = P.volume_m3(F.lit(2e5)), P.dam_height_m(P.volume_m3(F.lit(2e5)))
    r = one(spark, v=v, h=h, d=P.blockage_index(F.lit(250.0), h, v), capped=P.dam_height_m(v, F.lit(20.0)), free=P.dam_height_m(v, F.lit(None).cast("double")))
    assert r.v == pytest.approx(1680060.07, abs=0.01) and r.h == pytest.approx(118.8799, abs=1e-4) and r.d == pytest.approx(4.24772, abs=1e-5)
    assert r.capped == 20.0 and r.free == r.h


@pytest.mark.parametrize("value, expected", [(0.0, "stable"), (2.74, "stable"), (2.75, "uncertain"), (3.08, "uncertain"), (3.09, "breach_risk"), (None, None)])
def test_verdict(spark, value, expected):
    assert one(spark, v=P.verdict(F.lit(value).cast("double"))).v == expected


@pytest.mark.parametrize("area", [0.0, -1.0, -100.0])
def test_bad_values_are_null_or_raise(spark, area):
    assert one(spark, v=P.volume_m3(F.lit(area))).v is None
    with pytest.raises(Exception, match="must be above 0"):
        one(spark, v=P.volume_m3(F.lit(area), strict=True))
    with pytest.raises(Exception, match="unknown verdict"):
        one(spark, v=P.verdict_base(F.lit("so so")))


def test_weights_and_decay(spark):
    r = one(spark, bridge=P.asset_weight(F.lit("bridge")), other=P.asset_weight(F.lit("mystery_type")), none=P.asset_weight(F.lit(None).cast("string")), d=P.decayed(F.lit(1.0), F.lit(8.0)))
    assert (r.bridge, r.other, r.none, r.d) == (0.95, 0.5, 0.5, round(math.exp(-1), 4))


@pytest.mark.parametrize(
    "points, area", [([(0, 0), (10, 0), (10, 10), (0, 10)], 100), ([(0, 10), (10, 10), (10, 0), (0, 0)], 100), ([(0, 0), (4, 0), (0, 3)], 6), ([(0, 0), (1, 1), (2, 2)], 0), ([(0, 0), (1, 1)], 0), ([], 0)]
)
def test_polygon_area(spark, points, area):
    p = lit_poly(points)
    r = one(spark, px=G.area_px(p), m2=G.area_m2(p), big=G.area_m2(p, 20.0))
    assert (r.px, r.m2, r.big) == (area, area * 100, area * 400)


def test_labels_round_trip(spark):
    p = lit_poly([(1, 2), (3, 2), (3, 5)])
    r = one(spark, line=G.label_line(G.to_flat(p, F.lit(8), F.lit(16))), back=G.parse_label(G.label_line(G.to_flat(p, F.lit(8), F.lit(16)))), blank=G.parse_label(F.lit("  ")), none=G.parse_label(F.lit(None).cast("string")))
    assert r.line == "0 0.125000 0.125000 0.375000 0.125000 0.375000 0.312500"
    assert r.back.label == 0 and r.back.flat == [0.125, 0.125, 0.375, 0.125, 0.375, 0.3125]
    assert r.blank is None and r.none is None
    flat = F.array(*map(F.lit, (0.5, 0.25, 1.0)))
    assert [tuple(c) for c in one(spark, c=G.from_flat(flat, F.lit(8), F.lit(4))).c] == [(4.0, 1.0)]


def test_bands(spark):
    d = lambda v: F.lit(v).cast("double")
    r = one(spark, a=B.ndwi(d(0.3), d(0.05)), b=B.ndwi(d(0.1), d(0.4)), zero=B.ndwi(d(0), d(0)), none=B.ndwi(d(None), d(1)), three=B.three_bands(F.array(F.lit(1), F.lit(2))), heat=B.heat(d(5)), cold=B.heat(d(-5)))
    assert r.a > 0 > r.b and r.zero == 0.0 and r.none is None and r.three == [1, 2, 1]
    assert tuple(r.heat) == (0, 0, 255) and tuple(r.cold) == (255, 0, 0)
    assert one(spark, a=B.binary_mask(F.lit(127)), b=B.binary_mask(F.lit(128)), c=B.normalised_mask(F.lit(1))).asDict() == {"a": False, "b": True, "c": 255}


def test_geodesic_distance(spark):
    r = one(spark, d=D.geodesic_m(F.lit(50.06632), F.lit(-5.71475), F.lit(58.64402), F.lit(-3.07009)), zero=D.geodesic_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), equator=D.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert r.d == pytest.approx(969954.1663, abs=1e-3) and r.zero == 0.0 and r.equator == pytest.approx(111319.4908, abs=1e-3)


def test_utm(spark):
    r = one(spark, u=D.to_utm(F.lit(28.102103), F.lit(85.239333), F.lit("EPSG:32645")), s=D.to_utm(F.lit(-13.5), F.lit(-69.5), F.lit("EPSG:32719")), none=D.to_utm(F.lit(1.0), F.lit(1.0), F.lit("EPSG:3857")), mid=D.to_utm(F.lit(0.0), F.lit(87.0), F.lit("EPSG:32645")))
    assert r.none is None and r.mid.x == pytest.approx(500000, abs=1e-6) and r.mid.y == pytest.approx(0, abs=1e-6)
    assert 300000 < r.u.x < 340000 and r.s.y > 8_000_000
    b = one(spark, b=D.from_utm(F.lit(r.u.x), F.lit(r.u.y), F.lit("EPSG:32645")), g=D.from_utm(F.lit(85.0), F.lit(28.0), F.lit("EPSG:4326")))
    assert b.b.lat == pytest.approx(28.102103, abs=1e-9) and b.b.lon == pytest.approx(85.239333, abs=1e-9) and tuple(b.g) == (28.0, 85.0)
    # the same by meridian distance: along the central meridian northings are meridian arcs times 0.9996
    m = one(spark, u=D.to_utm(F.lit(28.0), F.lit(87.0), F.lit("EPSG:32645")), d=D.geodesic_m(F.lit(0.0), F.lit(87.0), F.lit(28.0), F.lit(87.0)))
    assert m.u.y == pytest.approx(m.d * 0.9996, abs=1e-3)


@pytest.mark.parametrize("path, source", [("a.jpg", "fallback"), ("a.TIF", "geotiff_crs"), (None, "fallback")])
def test_ground_resolution(spark, path, source):
    t = F.array(*[F.lit(float(v)) for v in (0.0003, 0, 85.0, 0, -0.0003, 28.0)])
    p = F.lit(path).cast("string")
    g = one(spark, g=D.ground_resolution(p, t, F.lit(100), F.lit(100), F.lit("EPSG:4326"), 7.0)).g
    assert g.source == source and (g.gsd == 7.0 if source == "fallback" else 20 < g.gsd < 40)
    assert one(spark, g=D.ground_resolution(p, t, F.lit(100), F.lit(100), F.lit(None).cast("string"), 7.0)).g.gsd == 7.0


def test_names(spark):
    s = lambda v: F.lit(v).cast("string")
    r = one(
        spark, a=X.clean_name(s(None), s("road")), b=X.poi_kind(s("school"), s("village")), c=X.poi_kind(s("cafe"), s("village")), d=X.poi_kind(s("cafe"), s("suburb")), e=X.road_kind(s("no")), f=X.road_kind(s(None)),
        k=X.after_first_underscore(s("image_a_b.png")), n=X.after_first_underscore(s("image.png")), t=X.stem(s("x/y.tar.gz")), w=X.without_affix(s("b_12_mask"), "b_", "_mask"), p=X.part_from_end(s("a/b"), 5), i=X.scar_id(s("chip"), F.lit(3)),
    )
    assert tuple(r) == ("unnamed road", "school", "settlement", "other", "bridge", "road", "a_b.png", None, "y.tar", "12", None, "chip-scar3")


@pytest.mark.parametrize(
    "text, parts",
    [
        ("POINT (1 2)", [(POINT, [(1, 2)])]), ("point(1 2)", [(POINT, [(1, 2)])]), ("SRID=4326;POINT Z (1 2 3)", [(POINT, [(1, 2)])]), (" LineString  (1 2,3 4) ", [(LINE, [(1, 2), (3, 4)])]),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0), (.1 .1, .2 .1, .2 .2, .1 .1))", [(RING, [(0, 0), (1, 0), (1, 1), (0, 0)]), (RING, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.1)])]),
        ("MULTIPOINT ((1 2), (3 4))", [(POINT, [(1, 2)]), (POINT, [(3, 4)])]), ('{ "coordinates": [[1,2],[3,4]], "type": "LineString" }', [(LINE, [(1, 2), (3, 4)])]),
        ("LINESTRING (179.9 0, -179.9 0)", [(LINE, [(179.9, 0), (180.1, 0)])]),
        (None, []), ("", []), ("n/a", []), ("POINT EMPTY", []), ("POINT (nan nan)", []), ('{"type":"Point","coordinates":[]}', []), ('{"type":"Point"', []), ("POINT (1 x)", []), ("LINESTRING (1 2, 3)", []),
    ],
)
def test_read_geometry(text, parts):
    got = [(k, [(round(x, 9), round(y, 9)) for x, y in v]) for k, v in read_geometry(text)]
    assert got == parts
