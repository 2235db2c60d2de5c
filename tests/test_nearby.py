import math
import random

from cartolith.operators import nearby as N


def brute_near(points, r):
    return sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= r)


def points_df(spark, points):
    return spark.createDataFrame(points, "id bigint, lon double, lat double")


def test_near_pairs(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(0, 0.01), rnd.uniform(-0.005, 0.005)) for i in range(300)]
    pts += [(1000 + i, 5.0, 5.0) for i in range(12)]  # in one spot
    pts += [(2000, -180.0, -90.0), (2001, -180.0, -89.9999), (2002, 180.0, 90.0), (2003, 179.9999, 90.0)]
    for r in (0.0, 0.0004, 0.002):
        got = sorted(map(tuple, N.near_pairs(points_df(spark, pts), r).collect()))
        assert got == brute_near(pts, r), r


def test_full_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_MOST", 20)
    rnd = random.Random(14)
    pts = [(i, rnd.gauss(1, 0.0003), rnd.gauss(1, 0.0003)) for i in range(260)] + [(500 + i, 1.0, 1.0) for i in range(30)] + [(900 + i, rnd.uniform(0, 2), rnd.uniform(0, 2)) for i in range(80)]
    assert sorted(map(tuple, N.near_pairs(points_df(spark, pts), 0.0004).collect())) == brute_near(pts, 0.0004)


def test_near_pairs_bad_input(spark):
    pts = [(1, None, 1.0), (2, float("nan"), 1.0), (None, 1.0, 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0)]
    assert N.near_pairs(points_df(spark, pts), 0.1).collect() == [(3, 4)]
    assert N.near_pairs(points_df(spark, []), 0.1).count() == 0
    assert N.near_pairs(points_df(spark, pts), -1.0).count() == 0
    assert N.near_pairs(points_df(spark, pts), float("nan")).count() == 0


def inside(p, ring):
    odd = False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
        if (ya > p[1]) != (yb > p[1]) and p[0] < (xb - xa) * (p[1] - ya) / (yb - ya) + xa:
            odd = not odd
    return odd


def test_regions(spark):
    rnd = random.Random(9)
    pts = [(i, rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(500)] + [(900, None, 0.0)]
    probes = [(1, 0.0, 0.0, 0.5), (1, 0.0, 0.0, 0.5), (1, 1.0, 1.0, 0.7), (2, None, 0.0, 1.0), (3, 0.0, 0.0, float("nan")), (4, 0.0, 0.0, -1.0), (5, 1.5, -1.5, 0.0), (6, -1.0, 1.0, 200.0)]
    pts.append((901, 1.5, -1.5))
    zones = {7: {0: [(-1, -1), (1, -1), (1, 1), (-1, 1)], 1: [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5)]}, 8: {0: [(0, 0), (2, 0), (0, 2)]}, 9: {1: [(0, 0), (1, 0), (1, 1)]}, 10: {0: [(0, 0), (1, 1)]}}
    verts = [(z, r, k, float(x), float(y)) for z, rs in zones.items() for r, ring in rs.items() for k, (x, y) in enumerate(ring)]
    verts += [verts[0], (8, 0, 99, None, 1.0)]
    rnd.shuffle(verts)
    pr = spark.createDataFrame(probes, "point_id bigint, lon double, lat double, radius_deg double")
    ve = spark.createDataFrame(verts, "zone_id bigint, ring_no int, vertex_no int, lon double, lat double")
    box, shapes = N.zone_regions(ve, "zone")
    got = sorted(map(tuple, N.points_in_regions(points_df(spark, pts), N.disc_regions(pr, "point", "point_id", "radius_deg").unionByName(box), shapes).collect()))
    ok = [p for p in pts if p[1] is not None]
    want = {("point", q[0], p[0]) for q in probes for p in ok if q[1] is not None and q[3] >= 0 and math.hypot(q[1] - p[1], q[2] - p[2]) <= q[3]}
    want |= {("zone", z, p[0]) for z in (7, 8) for p in ok if inside(p[1:], zones[z][0]) and not any(inside(p[1:], r) for n, r in zones[z].items() if n)}
    assert got == sorted(want)
    none = N.disc_regions(pr.where("point_id = 2"), "point", "point_id", "radius_deg")
    assert N.points_in_regions(points_df(spark, pts), none, shapes).count() == 0


def test_huge_regions(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(-180, -90), (180, 90), (0.5, 0.5), (179.99, 0), (-100, 45)])]
    probes = [(1, 0.0, 0.0, 200.0), (2, 5.0, 5.0, 2e5), (3, 0.0, 0.0, 1e6), (4, -170.0, 80.0, float("inf")), (5, 900.0, 0.0, 721.0), (6, 900.0, 0.0, 1.0), (7, 0.0, 0.0, 1.7e308), (8, float("inf"), 0.0, 5.0)]
    discs = N.disc_regions(spark.createDataFrame(probes, "point_id bigint, lon double, lat double, radius_deg double"), "point", "point_id", "radius_deg")
    assert N.cover(discs).count() < 400 * len(probes)
    ve = spark.createDataFrame([], "zone_id bigint, ring_no int, vertex_no int, lon double, lat double")
    _, shapes = N.zone_regions(ve, "zone")
    got = sorted((r["rid"], r["id"]) for r in N.points_in_regions(points_df(spark, pts), discs, shapes).collect())
    assert got == sorted((q[0], p[0]) for q in probes for p in pts if math.isfinite(q[1]) and math.hypot(q[1] - p[1], q[2] - p[2]) <= q[3])


def test_zone_of_holes_only(spark):
    ve = spark.createDataFrame([(9, 1, 0, 0.0, 0.0), (9, 1, 1, 1.0, 0.0), (9, 1, 2, 1.0, 1.0)], "zone_id bigint, ring_no int, vertex_no int, lon double, lat double")
    box, shapes = N.zone_regions(ve, "zone")
    disc = N.disc_regions(spark.createDataFrame([(1, 0.5, 0.2, 0.1)], "point_id bigint, lon double, lat double, radius_deg double"), "point", "point_id", "radius_deg")
    assert [tuple(r) for r in N.points_in_regions(points_df(spark, [(4, 0.5, 0.2)]), box.unionByName(disc), shapes).collect()] == [("point", 1, 4)]
