"""Queries of the general data-pipeline problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import nearby as N
from ..operators import orphans as O
from ..operators import skew as S
from ..session import materialize
from ..sources.tables import located, table, tag_rows

#: Degrees within which two nodes are near.
NEAR = 0.0004


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = materialize(located(table(spark, d, "nodes")), "located")
    near = N.near_pairs(nodes, NEAR).select(F.lit("near").alias("kind"), "id_a", "id_b")
    box, shapes = N.zone_regions(table(spark, d, "zones"), "zone")
    discs = N.disc_regions(table(spark, d, "probe_points"), "point", "point_id", "radius_deg")
    hit = N.points_in_regions(nodes, discs.unionByName(box), shapes)
    return near.unionByName(hit.select("kind", F.col("rid").alias("id_a"), F.col("id").alias("id_b")))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tag_rows(table(spark, d, "tags")).select("key_idx", "slot"), "tag-rows")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return S.dominant_keys(_tags(spark, d))


def p4_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.key_totals(_tags(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(spark, d).groupBy("tab", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(H.relation_links(spark, d))
    return h.select("rel_id", "state", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.relation_links(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_key_totals, p5_found, p5_report, p6_found, p6_descendants)}
