import math

import pytest
from pyspark.sql import functions as F

from cartolith.functions import geom as G
from cartolith.functions import zcurve as Z


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(x).cast("bigint") for x in xs]


@pytest.mark.parametrize("p,a,b,inside,outside", [
    ((7, 2), (1, 9), (20, 9), 49, 48), ((26, 17), (1, 9), (20, 9), 100, 99), ((-4, -3), (1, 9), (20, 9), 169, 168),
    ((6, 0), (0, 0), (6, 6), 18, 17), ((2, 1), (0, 0), (3, 4), 1, 0), ((8, 15), (0, 0), (0, 0), 289, 288),
    # corners of the world
    ((0, 0), (-1800000000, -900000000), (1800000000, 900000000), 0, None), ((0, 1), (-1800000000, -900000000), (1800000000, 900000000), 1, 0)])
def test_segment_within(spark, p, a, b, inside, outside):
    at = lits(*p, *a, *b)
    r = lambda x: F.lit(x).cast("decimal(38,0)")
    assert value(spark, G.segment_within(*at, r(inside)))
    assert outside is None or not value(spark, G.segment_within(*at, r(outside)))


#: A right-angled corner: two arms of a hook.
HOOK = [(0, 0), (12, 0), (12, 3), (3, 3), (3, 12), (0, 12)]


@pytest.mark.parametrize("seg,hit", [
    ((1, 1, 2, 2), True), ((-4, 6, 9, 6), True), ((3, 3, 8, 8), True), ((12, 3, 15, 9), True), ((6, -2, 6, 0), True), ((-1, 13, 1, 11), True), ((14, 2, 2, 14), False), ((16, -4, -4, 16), True),
    ((4, 4, 12, 12), False), ((4, 11, 11, 4), False), ((13, 0, 13, 3), False), ((-3, -1, 14, -1), False)])
def test_hook_and_segments(spark, seg, hit):
    poly = G.Polygon([(x / G.SCALE, y / G.SCALE) for x, y in HOOK])
    poly.vertices = HOOK
    lit = [tuple(lits(*v)) for v in HOOK]
    poly._edges = list(zip([lit[-1], *lit[:-1]], lit))
    assert value(spark, poly.segment(*lits(*seg))) is hit


def test_boundary_counts(spark):
    poly = G.Polygon([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    for x, y, want in ((0, 0, True), (5_000_000, 0, True), (10_000_000, 10_000_000, True), (5_000_000, 5_000_000, True), (10_000_001, 5, False)):
        assert value(spark, poly.point(*lits(x, y))) is want


def test_bad_shapes():
    assert not G.Radius(0, 0, -1).valid and not G.Radius(math.nan, 0, 1).valid and not G.Polygon([(0, 0), (1, 1)]).valid
    assert G.Box(1, 0, 0, 1).clamped() is None and G.Box(math.nan, 0, 1, 1).clamped() is None and G.Box(200, 0, 300, 1).clamped() is None
    assert not G.Box(0, 0, math.inf, 1).valid() and G.Box(-999, -999, 999, 999).clamped().sides == (-180, -90, 180, 90)


def test_ray_and_area(spark):
    d = lambda *xs: [F.lit(float(x)) for x in xs]
    for seg, p, want in (((1, 0, 1, 2), (0, 1), 1), ((1, 2, 1, 0), (0, 1), -1), ((1, 0, 1, 2), (2, 1), 0), ((1, 0, 1, 2), (0, 2), 0), ((1, 0, 1, 2), (0, 0), 1), ((0, 1, 2, 1), (0, 1), 0)):
        assert value(spark, G.ray_crossing(*d(*seg), *d(*p))) == want
    ring = lambda pts: F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts))
    ccw = value(spark, G.ring_area_m2(ring([(0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01)])))
    cw = value(spark, G.ring_area_m2(ring([(0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0)])))
    assert ccw > 0 > cw and abs(ccw + cw) < 1e-6 and abs(ccw - 1113.19**2) < 2e3
    assert value(spark, G.ring_area_m2(ring([(0, 0), (1, 1)]))) == 0.0


def test_mercator(spark):
    assert abs(value(spark, G.mercator_lon(F.lit(20037508.342789244))) - 180) < 1e-9
    assert abs(value(spark, G.mercator_lat(F.lit(0.0)))) < 1e-12


def test_codes(spark):
    for x, y in ((0, 0), (1, 0), (0, 1), (5, 9), (2**30 + 3, 2**29 + 7)):
        want = sum((((x >> i) & 1) << (2 * i + 1)) | (((y >> i) & 1) << (2 * i)) for i in range(31))
        assert value(spark, Z.interleave(*lits(x, y))) == want
    fine = Z.cell(F.lit(12.345), F.lit(-67.89), 20)
    for lv in (0, 3, 12, 20):
        assert value(spark, Z.prefix(fine, 20, lv)) == value(spark, Z.cell(F.lit(12.345), F.lit(-67.89), lv))
