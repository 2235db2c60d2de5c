"""Points near points, and points in discs and regions.

Every search shape is covered by cells of the Z-order curve, that is by code
ranges with a common prefix. Range containment then is equality of prefixes,
which Spark runs as a merge join over sorted codes (or a hash join where the
cover is small); an exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zcurve as Z
from ..session import BROADCAST_LIMIT, bounded, saved

_PAD = 1e-9
#: Points a cell may have; the pairs of a fuller one are spread over several tasks.
CELL_MOST = 20_000


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """id_a < id_b of all pairs of points (id, lon, lat) at most radius degrees apart.

    A point goes to its own cell and to those cells of its disc that come after
    it by column and row, so each pair meets in one cell only. Both sides of the
    self-join are the same plan up to the exchange, so points are shuffled once.
    Cells of more than CELL_MOST points are counted first: there one side is
    dealt to parts and the other sent to each of them. Null or NaN places and
    ids match nothing; equal places match; a radius below 0 matches nothing.
    """
    spark = points.sparkSession
    if not math.isfinite(radius) or radius < 0:
        return spark.createDataFrame([], "id_a bigint, id_b bigint")
    level = min(Z.MAX_LEVEL, int(math.log2(360.0 / max(2.0 * radius, 1e-9))))
    w, r = Z.width(level), radius + _PAD
    p = points.select("id", "lon", "lat").dropna()
    x, y = F.col("lon"), F.col("lat")
    at = {"cx": Z.column_of(x, w), "cy": Z.row_of(y, w)}
    # a disc spans at most two columns and two rows, as a cell is as wide as it or wider
    at |= {"ox": Z.column_of(x - r, w) + Z.column_of(x + r, w) - at["cx"], "oy": Z.row_of(y - r, w) + Z.row_of(y + r, w) - at["cy"]}
    p = p.where(~F.isnan("lon") & ~F.isnan("lat")).select("id", "lon", "lat", *(c.alias(k) for k, c in at.items()))
    cell = lambda cx, cy: F.struct(F.col(cx).alias("x"), F.col(cy).alias("y"))
    east, north = F.col("ox") > F.col("cx"), F.col("oy") > F.col("cy")
    cells = F.array(cell("cx", "cy"), F.when(east, cell("ox", "cy")), F.when(north, cell("cx", "oy")), F.when(east & (F.col("oy") != F.col("cy")), cell("ox", "oy")))
    p = p.select("id", "lon", "lat", "cx", "cy", F.explode(F.array_compact(cells)).alias("c"))
    home = (F.col("c.x") == F.col("cx")) & (F.col("c.y") == F.col("cy"))
    p = p.select(Z.interleave(F.col("c.x"), F.col("c.y"), level + 1).alias("code"), "id", "lon", "lat", home.alias("home"))
    full, n = saved(p.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / CELL_MOST).alias("parts")).where("parts > 1"), "full-cells")
    if not n["n"]:
        return _close(p, p, radius)
    # at most as many cells as points / CELL_MOST
    listed = F.broadcast(full) if n["n"] * 40 <= BROADCAST_LIMIT else full
    cold, hot = p.join(listed, "code", "left_anti"), p.join(listed, "code")
    dealt = hot.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    sent = hot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return _close(cold, cold, radius).unionByName(_close(dealt, sent, radius, "part"))


def _close(left: DataFrame, right: DataFrame, radius: float, *keys: str) -> DataFrame:
    """Pairs of two sides of one cell (and keys) at most radius apart, each once."""
    a, b = left.alias("a"), right.alias("b")
    # of both sides at once, so that no part of it is pushed below one side's exchange
    meets = F.when(F.col("b.home"), F.col("a.home") & (F.col("a.id") < F.col("b.id"))).otherwise(F.col("a.home"))
    close = distance(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) <= F.lit(float(radius))
    on = F.col("a.code") == F.col("b.code")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    j = a.join(b, on & meets & close & (F.col("a.id") != F.col("b.id")))
    return j.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def disc_regions(probes: DataFrame, kind: str, id_col: str, radius_col: str) -> DataFrame:
    """Discs as regions; rows with a null, NaN or negative value find nothing, repeats count once; an infinite radius is the world."""
    ok = ~(F.isnan("lon") | F.isnan("lat") | F.isnan(radius_col)) & (F.col(radius_col) >= 0)
    d = probes.select(F.col(id_col).alias("rid"), "lon", "lat", radius_col).dropna().where(ok).distinct()
    r = F.col(radius_col)
    return d.select(
        F.lit(kind).alias("kind"), "rid",
        F.col("lon").alias("cx"), F.col("lat").alias("cy"), r.alias("radius"),
        (F.col("lon") - r - _PAD).alias("x0"), (F.col("lon") + r + _PAD).alias("x1"),
        (F.col("lat") - r - _PAD).alias("y0"), (F.col("lat") + r + _PAD).alias("y1"),
    )


def ring_edges(vertices: DataFrame) -> DataFrame:
    """zone_id, ring_no, edges of each ring, from vertex rows in any order.

    Null places are left out, of rows with one vertex number the smallest place
    counts, a repeated first vertex adds an edge without length. Rings of fewer
    than three vertices are dropped.
    """
    v = vertices.select("zone_id", "ring_no", "vertex_no", "lon", "lat").dropna()
    v = v.groupBy("zone_id", "ring_no", "vertex_no").agg(F.min(F.struct("lon", "lat")).alias("p"))
    g = v.groupBy("zone_id", "ring_no").agg(F.array_sort(F.collect_list(F.struct("vertex_no", "p"))).alias("vs"))
    g = g.where(F.size("vs") >= 3).withColumn("ps", F.transform("vs", lambda s: s["p"]))
    rot = F.concat(F.slice(F.col("ps"), 2, F.size("ps")), F.slice(F.col("ps"), 1, 1))
    edge = lambda a, b: F.struct(a["lon"].alias("xa"), a["lat"].alias("ya"), b["lon"].alias("xb"), b["lat"].alias("yb"))
    return g.select("zone_id", "ring_no", F.zip_with(F.col("ps"), rot, edge).alias("edges"), "ps")


def zone_regions(vertices: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of the zones' outer rings, and the zones' edges (rid, outer, holes).

    A zone without an outer ring contains nothing.
    """
    rings = ring_edges(vertices)
    box = rings.where("ring_no = 0").select(
        F.lit(kind).alias("kind"), F.col("zone_id").alias("rid"),
        F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"), F.lit(None).cast("double").alias("radius"),
        F.array_min(F.transform("ps", lambda p: p["lon"])).alias("x0"), F.array_max(F.transform("ps", lambda p: p["lon"])).alias("x1"),
        F.array_min(F.transform("ps", lambda p: p["lat"])).alias("y0"), F.array_max(F.transform("ps", lambda p: p["lat"])).alias("y1"),
    )
    shape = rings.groupBy(F.lit(kind).alias("kind"), F.col("zone_id").alias("rid")).agg(
        F.first(F.when(F.col("ring_no") == 0, F.col("edges")), ignorenulls=True).alias("outer"),
        F.collect_list(F.when(F.col("ring_no") != 0, F.col("edges"))).alias("holes"),
    )
    return box, shape


def cover(regions: DataFrame) -> DataFrame:
    """The cells that cover each region's box, at the level that fits its extent: level, code.

    Boxes are cut to the world first, so that none has more than about 17 x 17
    cells however large; one outside the world has none.
    """
    cut = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)).alias(c)
    regions = regions.where("x1 >= -180 and x0 <= 180 and y1 >= -90 and y0 <= 90")
    sides = {"x0": (-180.0, 180.0), "x1": (-180.0, 180.0), "y0": (-90.0, 90.0), "y1": (-90.0, 90.0)}
    regions = regions.select(*(cut(c, *sides[c]) if c in sides else c for c in regions.columns))
    lv = Z.fitting_level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    r = regions.withColumn("level", lv).withColumn("w", F.lit(360.0) / F.pow(F.lit(2.0), F.col("level")))
    xs = F.sequence(Z.column_of(F.col("x0"), F.col("w")), Z.column_of(F.col("x1"), F.col("w")))
    ys = F.sequence(Z.row_of(F.col("y0"), F.col("w")), Z.row_of(F.col("y1"), F.col("w")))
    r = r.withColumn("cx_no", F.explode(xs)).withColumn("cy_no", F.explode(ys))
    return r.withColumn("code", Z.interleave(F.col("cx_no"), F.col("cy_no"))).drop("w", "cx_no", "cy_no")


def _crossings_odd(edges: Column, lon: Column, lat: Column) -> Column:
    def crosses(e: Column) -> Column:
        spans = (e["ya"] > lat) != (e["yb"] > lat)
        at = (e["xb"] - e["xa"]) * (lat - e["ya"]) / F.nullif(e["yb"] - e["ya"], F.lit(0.0)) + e["xa"]
        return spans & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, shapes: DataFrame) -> DataFrame:
    """kind, rid, id of each point (id, lon, lat) in each disc or zone of regions.

    Each point looks up its code's prefix at every level the cover uses (at most
    MAX_LEVEL / 2 + 1). The cover is broadcast only after its size was checked; a
    larger one is joined by shuffle, where adaptive execution splits full cells.
    """
    cov = cover(regions)
    levels = sorted(r[0] for r in cov.select("level").distinct().collect())
    if not levels:
        return points.sparkSession.createDataFrame([], "kind string, rid bigint, id bigint")
    small = bounded(cov, 112)
    p = points.select("id", "lon", "lat").dropna()
    p = p.withColumn("fine", Z.cell(F.col("lon"), F.col("lat"), levels[-1]))
    keys = F.array(*(F.struct(F.lit(lv).alias("level"), Z.prefix(F.col("fine"), levels[-1], lv).alias("code")) for lv in levels))
    p = p.select("id", "lon", "lat", F.inline(keys))
    hit = p.join(F.broadcast(cov) if small else cov, ["level", "code"])
    lon, lat = F.col("lon"), F.col("lat")
    inbox = lon.between(F.col("x0"), F.col("x1")) & lat.between(F.col("y0"), F.col("y1"))
    in_disc = F.col("radius").isNull() | (distance(lon, lat, F.col("cx"), F.col("cy")) <= F.col("radius"))
    hit = hit.where(inbox & in_disc).select("kind", "rid", "id", "lon", "lat", "radius")
    outer = F.coalesce(F.size("outer"), F.lit(0))
    edges = shapes.agg(F.sum(F.greatest(outer, F.lit(0)) + F.aggregate("holes", F.lit(1), lambda n, h: n + F.size(h)))).first()[0] or 0
    hit = hit.join(F.broadcast(shapes) if edges * 40 <= BROADCAST_LIMIT else shapes, ["kind", "rid"], "left")
    inside = _crossings_odd(F.col("outer"), lon, lat) & ~F.exists("holes", lambda h: _crossings_odd(h, lon, lat))
    hit = hit.where(F.when(F.col("radius").isNull(), inside).otherwise(True)).select("kind", "rid", "id")
    # only a region id with several places can find a point twice
    several = regions.groupBy("kind", "rid").count().where("count > 1").limit(1).count()
    return hit.distinct() if several else hit
