"""Exact planar predicates as column expressions over whole units.

Products of coordinate differences are taken in DECIMAL(38); where a square
would pass it the comparison falls back to DOUBLE, as it does only for
segments and radii that span most of the globe.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SCALE, degrees  # noqa: F401

EARTH_M = 6378137.0


def big(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(18,0)")


#: What a stored coordinate or radius can be at least and at most.
LEAST, MOST = -(2**31), 2**31 - 1


def units(v: float) -> int:
    """Whole units of a coordinate, cut towards zero; one beyond what can be stored is the last that can."""
    return int(max(float(LEAST), min(float(MOST), v * SCALE)))


def first_from(v: float) -> int:
    """The least number of units that is v degrees or more."""
    u = math.floor(v * SCALE) - 1
    while u / SCALE < v:
        u += 1
    return u


def last_until(v: float) -> int:
    """The greatest number of units that is v degrees or less."""
    u = math.ceil(v * SCALE) + 1
    while u / SCALE > v:
        u -= 1
    return u


def dist_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = big(ax) - big(bx), big(ay) - big(by)
    return dx * dx + dy * dy


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cross product of a - o and b - o."""
    return (big(ax) - big(ox)) * (big(by) - big(oy)) - (big(ay) - big(oy)) * (big(bx) - big(ox))


def _along(px, py, ax, ay, bx, by):
    """Length squared of ab, and the part of ap along it."""
    dx, dy = big(bx) - big(ax), big(by) - big(ay)
    return dx * dx + dy * dy, (big(px) - big(ax)) * dx + (big(py) - big(ay)) * dy


def segment_within(px, py, ax, ay, bx, by, r_sq: Column) -> Column:
    """Whether p is at most the root of r_sq from segment ab."""
    len_sq, dot = _along(px, py, ax, ay, bx, by)
    c = cross(ax, ay, px, py, bx, by)
    exact = F.try_multiply(c, c) <= F.try_multiply(r_sq, len_sq)
    rough = c.cast("double") * c.cast("double") <= r_sq.cast("double") * len_sq.cast("double")
    return (F.when((len_sq == 0) | (dot <= 0), dist_sq(px, py, ax, ay) <= r_sq)
            .when(dot >= len_sq, dist_sq(px, py, bx, by) <= r_sq).otherwise(F.coalesce(exact, rough)))


def segment_dist_sq(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of p from segment ab, for ordering."""
    len_sq, dot = _along(px, py, ax, ay, bx, by)
    c = cross(ax, ay, px, py, bx, by).cast("double")
    return (F.when((len_sq == 0) | (dot <= 0), dist_sq(px, py, ax, ay).cast("double"))
            .when(dot >= len_sq, dist_sq(px, py, bx, by).cast("double")).otherwise(c * c / len_sq.cast("double")))


def on_segment(px, py, ax, ay, bx, by) -> Column:
    return ((cross(ax, ay, px, py, bx, by) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx))
            & py.between(F.least(ay, by), F.greatest(ay, by)))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd share a point, touching and overlap included."""
    s1, s2 = F.signum(cross(cx, cy, dx, dy, ax, ay)), F.signum(cross(cx, cy, dx, dy, bx, by))
    s3, s4 = F.signum(cross(ax, ay, bx, by, cx, cy)), F.signum(cross(ax, ay, bx, by, dx, dy))
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    return (proper | on_segment(ax, ay, cx, cy, dx, dy) | on_segment(bx, by, cx, cy, dx, dy)
            | on_segment(cx, cy, ax, ay, bx, by) | on_segment(dx, dy, ax, ay, bx, by))


class Box:
    """A closed box in degrees."""

    def __init__(self, min_lon: float, min_lat: float, max_lon: float, max_lat: float):
        self.sides = (min_lon, min_lat, max_lon, max_lat)

    def valid(self) -> bool:
        a, b, c, d = self.sides
        return all(map(math.isfinite, self.sides)) and a <= c and b <= d

    def clamped(self) -> Box | None:
        """Cut to the world; None if NaN, inverted or outside."""
        a, b, c, d = self.sides
        if any(map(math.isnan, self.sides)) or a > c or b > d or a > 180 or c < -180 or b > 90 or d < -90:
            return None
        return Box(max(a, -180.0), max(b, -90.0), min(c, 180.0), min(d, 90.0))

    def in_units(self) -> tuple[int, int, int, int] | None:
        """The clamped sides in whole units, so that tests on them are plain comparisons which reach the scan; None as for clamped()."""
        b = self.clamped()
        return b and (first_from(b.sides[0]), first_from(b.sides[1]), last_until(b.sides[2]), last_until(b.sides[3]))

    def has_point(self, lon: Column, lat: Column) -> Column:
        if (u := self.in_units()) is None:
            return F.lit(False)
        return lon.between(u[0], u[2]) & lat.between(u[1], u[3])

    def overlaps(self, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
        if (u := self.in_units()) is None:
            return F.lit(False)
        return (max_lon >= u[0]) & (min_lon <= u[2]) & (max_lat >= u[1]) & (min_lat <= u[3])


class Radius:
    """A disc: centre cut to units, radius rounded up, its box from the centre as given."""

    def __init__(self, lon: float, lat: float, radius: float):
        self.valid = all(map(math.isfinite, (lon, lat, radius))) and radius >= 0
        if self.valid:
            self.box = Box(lon - radius, lat - radius, lon + radius, lat + radius)
            self.x, self.y = F.lit(units(lon)).cast("bigint"), F.lit(units(lat)).cast("bigint")
            self.center = (units(lon), units(lat))
            self.r = min(MOST, math.ceil(radius * SCALE))
            self.r_sq = F.lit(self.r * self.r).cast("decimal(38,0)") if self.r * self.r < 2**63 else F.expr(f"cast('{self.r * self.r}' as decimal(38,0))")

    def point(self, x: Column, y: Column) -> Column:
        return dist_sq(self.x, self.y, x, y) <= self.r_sq

    def segment(self, ax, ay, bx, by) -> Column:
        return segment_within(self.x, self.y, ax, ay, bx, by, self.r_sq)


class Polygon:
    """A polygon with its boundary; vertices cut to units, its box from the vertices as given."""

    def __init__(self, vertices: list[tuple[float, float]]):
        self.valid = len(vertices) >= 3 and all(math.isfinite(c) for v in vertices for c in v)
        if self.valid:
            xs, ys = zip(*vertices)
            self.box = Box(min(xs), min(ys), max(xs), max(ys))
            self.vertices = [(units(x), units(y)) for x, y in vertices]
            lit = [(F.lit(x).cast("bigint"), F.lit(y).cast("bigint")) for x, y in self.vertices]
            self._edges = list(zip([lit[-1], *lit[:-1]], lit))

    def point(self, x: Column, y: Column) -> Column:
        border = reduce(lambda a, b: a | b, (on_segment(x, y, *p, *c) for p, c in self._edges))
        px, py = x.cast("double"), y.cast("double")

        def crosses(p, c):
            (xj, yj), (xi, yi) = [(v[0].cast("double"), v[1].cast("double")) for v in (p, c)]
            at = (xj - xi) * (py - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi
            return F.coalesce(((yi > py) != (yj > py)) & (px < at), F.lit(False)).cast("int")

        return border | (sum((crosses(p, c) for p, c in self._edges), F.lit(0)) % 2 == 1)

    def segment(self, ax, ay, bx, by) -> Column:
        xs, ys = zip(*self.vertices)
        near = ((F.greatest(ax, bx) >= min(xs)) & (F.least(ax, bx) <= max(xs))
                & (F.greatest(ay, by) >= min(ys)) & (F.least(ay, by) <= max(ys)))
        meets = reduce(lambda a, b: a | b, (segments_meet(ax, ay, bx, by, *p, *c) for p, c in self._edges))
        return near & (self.point(ax, ay) | self.point(bx, by) | meets)


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two places in degrees, on a plane at their mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2.0))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_M


def ray_crossing(ax, ay, bx, by, lon, lat) -> Column:
    """1 where ab crosses the ray to the east going north, -1 going south, else 0; the lower end belongs to ab, the upper does not."""
    up = ay < by
    lox, loy = F.when(up, ax).otherwise(bx), F.when(up, ay).otherwise(by)
    hix, hiy = F.when(up, bx).otherwise(ax), F.when(up, by).otherwise(ay)
    at = lox + (lat - loy) / F.nullif(hiy - loy, F.lit(0.0)) * (hix - lox)
    hit = (loy != hiy) & (loy <= lat) & (lat < hiy) & (at > lon)
    return F.when(F.coalesce(hit, F.lit(False)), F.when(up, 1).otherwise(-1)).otherwise(0)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / EARTH_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / EARTH_M)) * 2.0 - math.pi / 2)


def ring_area_m2(points: Column) -> Column:
    """Signed area of a ring of struct(lon, lat), counter-clockwise positive, on a plane at its mean latitude; 0 below three.

    Places are taken relative to the first, so that products stay small and the area exact to far below a square metre.
    """
    n = F.size(points)
    lats = F.transform(points, lambda p: p["lat"])
    mean = F.aggregate(lats, F.lit(0.0), lambda s, v: s + v) / n
    k = F.cos(F.radians(mean))
    o = F.get(points, F.lit(0))
    xy = F.transform(points, lambda p: F.struct((F.radians(p["lon"] - o["lon"]) * k * EARTH_M).alias("x"), (F.radians(p["lat"] - o["lat"]) * EARTH_M).alias("y")))
    turned = F.concat(F.slice(xy, 2, n), F.slice(xy, 1, 1))
    parts = F.zip_with(xy, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2.0)
