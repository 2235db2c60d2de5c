"""The map dataset: current, resolved tables that all operators work on."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import current, located, member_kind, table, tag_rows

#: Units of a degree. Coordinates are whole units, so that tests on them are exact.
SCALE = 10_000_000
KINDS = ("node", "way", "relation")


def scaled(c: Column) -> Column:
    """Whole units of a coordinate in degrees, cut towards zero and to 32 bits."""
    return F.when(c.isNotNull(), F.least(F.greatest(c * float(SCALE), F.lit(-(2.0**31))), F.lit(2.0**31 - 1))).cast("bigint")


def degrees(c: Column) -> Column:
    return c / float(SCALE)


@dataclass
class Dataset:
    """Lazy tables of a map.

    nodes (id, lon, lat in units), ways (id), way_refs (way_id, pos, node_id),
    relations (id and stored box in units, null without one), members (rel_id,
    pos, kind, ref_id, role), tags (etype, id, key, value), dictionary (key,
    value; also pairs that no element carries).
    """

    spark: SparkSession
    root: str
    properties: dict = field(default_factory=dict)

    def _raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return located(self._raw("nodes")).select("id", scaled(F.col("lon")).alias("lon"), scaled(F.col("lat")).alias("lat"))

    @cached_property
    def ways(self) -> DataFrame:
        return current(self._raw("ways"), ["id"], ["visible"]).where("visible").select("id")

    @cached_property
    def way_refs(self) -> DataFrame:
        refs = current(self._raw("way_refs"), ["way_id", "pos"], ["node_id"])
        return refs.join(self.ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")

    @cached_property
    def relations(self) -> DataFrame:
        box = ["min_lon", "min_lat", "max_lon", "max_lat"]
        r = current(self._raw("relations"), ["id"], [*box, "visible"]).where("visible")
        return r.select("id", *(scaled(F.col(c)).alias(c) for c in box))

    @cached_property
    def members(self) -> DataFrame:
        m = self._raw("members").withColumn("kind", member_kind(F.col("mtype")))
        m = current(m, ["rel_id", "pos"], ["kind", "ref_id", "role"])
        return m.join(self.relations.select(F.col("id").alias("rel_id")), "rel_id", "left_semi")

    @cached_property
    def dictionary(self) -> DataFrame:
        return self._raw("tag_slots").select("slot", "key", "value").dropna()

    @cached_property
    def tags(self) -> DataFrame:
        t = tag_rows(self._raw("tags")).join(self.dictionary, "slot")
        return t.select("etype", "id", "key", "value")
