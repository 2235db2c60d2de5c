"""Boxes, discs, nearest and polygons for nodes, ways and relations.

A way is the line through its resolved nodes, a way of one node a point; a
relation is all its members, followed through relations. Relations without a
stored box never match. Distances are planar, in degrees.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..model import Dataset
from ..session import rounds, saved, together

_NONE = "id bigint"
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


class Spatial:
    """Spatial searches over a dataset; results are DataFrames with id."""

    def __init__(self, data: Dataset):
        self.data, self.spark = data, data.spark

    # geometry tables

    @cached_property
    def vertices(self) -> DataFrame:
        """way_id, pos, lon, lat of resolved way nodes."""
        n = self.data.nodes.select(F.col("id").alias("node_id"), "lon", "lat")
        return self.data.way_refs.join(n, "node_id").select("way_id", "pos", "lon", "lat")

    @cached_property
    def segments(self) -> DataFrame:
        """way_id, ax, ay, bx, by of each step of a way; a way of one node is a step in place."""
        w = Window.partitionBy("way_id").orderBy("pos")
        nxt = [F.lead(c).over(w).alias(a) for c, a in (("lon", "bx"), ("lat", "by"))]
        s = self.vertices.select("way_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"), *nxt, F.lag("pos").over(w).isNull().alias("first"))
        s = s.where(F.col("bx").isNotNull() | F.col("first"))
        return s.select("way_id", "ax", "ay", F.coalesce("bx", "ax").alias("bx"), F.coalesce("by", "ay").alias("by"))

    @cached_property
    def way_boxes(self) -> DataFrame:
        return self.vertices.groupBy(F.col("way_id").alias("id")).agg(
            F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))

    def relation_parts(self, roots: DataFrame) -> DataFrame:
        """root, kind (0 node, 1 way), ref_id of all members below roots (id), through relations; loops end."""
        links = self.data.members.where("kind = 2 and ref_id is not null").select(F.col("rel_id").alias("rel"), F.col("ref_id").alias("next")).distinct()
        links = links.join(self.data.relations.select(F.col("id").alias("next")), "next", "left_semi")
        links, many = saved(links.select("rel", "next"), "links")
        front, n = saved(roots.select(F.col("id").alias("root"), F.col("id").alias("rel")).distinct(), "roots")
        fronts = [front]
        with rounds(self.spark, many["n"] + n["n"]):
            while n["n"]:
                nxt = front.join(links, "rel").select("root", F.col("next").alias("rel")).distinct()
                front, n = saved(nxt.join(together(fronts), ["root", "rel"], "left_anti"), "front")
                if n["n"]:
                    fronts.append(front)
        return self._parts_of(together(fronts))

    def _parts_of(self, seen: DataFrame) -> DataFrame:
        m = self.data.members.where("kind in (0, 1) and ref_id is not null").select(F.col("rel_id").alias("rel"), "kind", "ref_id").distinct()
        return seen.join(m, "rel").select("root", "kind", "ref_id").distinct()

    def closure(self) -> DataFrame:
        """rel_id, reach: every relation with itself and all relations below it."""
        links = self.data.members.where("kind = 2 and ref_id is not null").select(F.col("rel_id"), F.col("ref_id").alias("reach")).distinct()
        ids = self.data.relations.select(F.col("id"))
        links = links.join(ids.select(F.col("id").alias("reach")), "reach", "left_semi").select("rel_id", "reach")
        pairs, n = saved(links.unionByName(ids.select(F.col("id").alias("rel_id"), F.col("id").alias("reach"))).distinct(), "closure")
        with rounds(self.spark, n["n"]):
            while True:
                # paths of twice the length each time
                far = pairs.alias("a").join(pairs.alias("b"), F.col("a.reach") == F.col("b.rel_id")).select("a.rel_id", "b.reach")
                more, m = saved(far.distinct(), "closure")
                if m == n:
                    return more
                pairs, n = more, m

    # boxes

    def nodes_in_bbox(self, box: G.Box) -> DataFrame:
        return self.data.nodes.where(box.has_point(F.col("lon"), F.col("lat"))).select("id")

    def ways_in_bbox(self, box: G.Box) -> DataFrame:
        return self.way_boxes.where(box.overlaps(*(F.col(c) for c in BOX))).select("id")

    def relations_in_bbox(self, box: G.Box) -> DataFrame:
        r = self.data.relations
        return r.where(box.overlaps(*(F.col(c) for c in BOX))).select("id")

    def in_bbox(self, etype: str, box: G.Box) -> DataFrame:
        return {"node": self.nodes_in_bbox, "way": self.ways_in_bbox, "relation": self.relations_in_bbox}[etype](box)

    # shapes

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], _NONE)

    def _near(self, shape):
        """Whether a segment's box comes within a unit of the shape's: cheap, true of all that touch, and fit to be pushed to a scan."""
        x0, y0, x1, y1 = (c * G.SCALE for c in shape.box.sides)
        ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
        low = lambda v: math.floor(max(v, -1e15)) - 1
        high = lambda v: math.ceil(min(v, 1e15)) + 1
        return (((ax >= low(x0)) | (bx >= low(x0))) & ((ax <= high(x1)) | (bx <= high(x1)))
                & ((ay >= low(y0)) | (by >= low(y0))) & ((ay <= high(y1)) | (by <= high(y1))))

    def _hit_segments(self, shape) -> DataFrame:
        return self.segments.where(self._near(shape)).where(shape.segment(*(F.col(c) for c in ("ax", "ay", "bx", "by"))))

    def _nodes(self, shape) -> DataFrame:
        n = self.data.nodes.where(shape.box.has_point(F.col("lon"), F.col("lat")))
        return n.where(shape.point(F.col("lon"), F.col("lat")))

    def _ways(self, shape, *more) -> DataFrame:
        """Ways that touch the shape and whose box meets its box, in one pass over the segments."""
        hit = F.max(F.when(self._near(shape), shape.segment(*(F.col(c) for c in ("ax", "ay", "bx", "by")))).otherwise(False))
        box = [F.min(F.least("ax", "bx")).alias("min_lon"), F.min(F.least("ay", "by")).alias("min_lat"), F.max(F.greatest("ax", "bx")).alias("max_lon"), F.max(F.greatest("ay", "by")).alias("max_lat")]
        w = self.segments.groupBy(F.col("way_id").alias("id")).agg(hit.alias("hit"), *box, *more)
        return w.where(F.col("hit") & shape.box.overlaps(*(F.col(c) for c in BOX)))

    def nodes_touching(self, shape) -> DataFrame:
        return self._nodes(shape).select("id") if shape.valid else self._nothing()

    def ways_touching(self, shape) -> DataFrame:
        return self._ways(shape).select("id") if shape.valid else self._nothing()

    def relations_touching(self, shape) -> DataFrame:
        return self._relations(shape, F.lit(0.0), F.lit(0.0)).select("id") if shape.valid else self._nothing()

    def _relations(self, shape, node_d2: Column, segment_d2: Column) -> DataFrame:
        """id, d2 (the least of what is given for nodes and segments) of relations whose stored box meets the shape's and of which a part touches it."""
        parts = self.relation_parts(self.relations_in_bbox(shape.box))
        n = self._near_nodes(shape).select(F.lit(0).alias("kind"), F.col("id").alias("ref_id"), node_d2.cast("double").alias("d2"))
        w = self._hit_segments(shape).groupBy(F.lit(1).alias("kind"), F.col("way_id").alias("ref_id")).agg(F.min(segment_d2).alias("d2"))
        return parts.join(n.unionByName(w), ["kind", "ref_id"]).groupBy(F.col("root").alias("id")).agg(F.min("d2").alias("d2"))

    def _near_nodes(self, shape) -> DataFrame:
        x0, y0, x1, y1 = (c * G.SCALE for c in shape.box.sides)
        low, high = lambda v: math.floor(max(v, -1e15)) - 1, lambda v: math.ceil(min(v, 1e15)) + 1
        n = self.data.nodes.where(F.col("lon").between(low(x0), high(x1)) & F.col("lat").between(low(y0), high(y1)))
        return n.where(shape.point(F.col("lon"), F.col("lat")))

    def touching(self, etype: str, shape) -> DataFrame:
        return {"node": self.nodes_touching, "way": self.ways_touching, "relation": self.relations_touching}[etype](shape)

    # distances

    def _node_dist(self, cx: int, cy: int) -> DataFrame:
        x, y = F.lit(cx).cast("bigint"), F.lit(cy).cast("bigint")
        return self.data.nodes.select("id", G.dist_sq(x, y, F.col("lon"), F.col("lat")).alias("d2"))

    def _way_dist(self, cx: int, cy: int) -> DataFrame:
        x, y = F.lit(cx).cast("bigint"), F.lit(cy).cast("bigint")
        d = G.segment_dist_sq(x, y, *(F.col(c) for c in ("ax", "ay", "bx", "by")))
        return self.segments.select(F.col("way_id").alias("id"), d.alias("d2")).groupBy("id").agg(F.min("d2").alias("d2"))

    def _relation_dist(self, cx: int, cy: int, roots: DataFrame) -> DataFrame:
        parts = self.relation_parts(roots)
        n = self._node_dist(cx, cy).select(F.lit(0).alias("kind"), F.col("id").alias("ref_id"), F.col("d2").cast("double").alias("d2"))
        w = self._way_dist(cx, cy).select(F.lit(1).alias("kind"), F.col("id").alias("ref_id"), "d2")
        return parts.join(n.unionByName(w), ["kind", "ref_id"]).groupBy(F.col("root").alias("id")).agg(F.min("d2").alias("d2"))

    def within_radius(self, etype: str, lon: float, lat: float, radius: float) -> DataFrame:
        """id and d2 (squared units) of elements in a disc, for orderBy("d2", "id"); a bad disc holds none."""
        shape = G.Radius(lon, lat, radius)
        if not shape.valid:
            return self.spark.createDataFrame([], "id bigint, d2 double")
        x, y = (F.lit(c).cast("bigint") for c in shape.center)
        if etype == "node":
            return self._nodes(shape).select("id", G.dist_sq(x, y, F.col("lon"), F.col("lat")).cast("double").alias("d2"))
        if etype == "way":
            # the nearest segment of a way that is touched is near itself
            d = G.segment_dist_sq(x, y, *(F.col(c) for c in ("ax", "ay", "bx", "by")))
            return self._ways(shape, F.min(F.when(self._near(shape), d)).alias("d2")).select("id", "d2")
        # what is nearest of a relation that is touched touches itself
        d = G.segment_dist_sq(x, y, *(F.col(c) for c in ("ax", "ay", "bx", "by")))
        return self._relations(shape, G.dist_sq(x, y, F.col("lon"), F.col("lat")), d).select("id", "d2")

    def nearest(self, etype: str, lon: float, lat: float, k: int) -> DataFrame:
        """The k nearest elements, ties by id: one pass with a bounded heap in each task."""
        if k <= 0 or not G.Radius(lon, lat, 0).valid:
            return self.spark.createDataFrame([], "id bigint, d2 double")
        at = (G.units(lon), G.units(lat))
        if etype == "relation":
            dist = self._relation_dist(*at, self.data.relations.where("min_lon is not null").select("id"))
        else:
            dist = self._node_dist(*at) if etype == "node" else self._way_dist(*at)
        return dist.orderBy("d2", "id").limit(k).select("id", F.col("d2").cast("double").alias("d2"))
