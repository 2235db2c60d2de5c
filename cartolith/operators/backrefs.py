"""Reverse references: which ways use a node, which relations hold an element."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KINDS, Dataset
from ..session import materialize
from .taginfo import Taginfo


class Backrefs:
    """Pairs of child and parent; repeats within a parent count once, unresolved references are left out."""

    def __init__(self, data: Dataset):
        self.data = data

    @cached_property
    def node_ways(self) -> DataFrame:
        r = self.data.way_refs.where("node_id is not null").select(F.col("node_id").alias("child"), F.col("way_id").alias("parent")).distinct()
        return r.join(self.data.nodes.select(F.col("id").alias("child")), "child", "left_semi")

    def parents(self, etype: str) -> DataFrame:
        """child, parent of elements of a type and the relations that hold them directly."""
        ids = {"node": self.data.nodes, "way": self.data.ways, "relation": self.data.relations}[etype]
        m = self.data.members.where((F.col("kind") == KINDS.index(etype)) & F.col("ref_id").isNotNull())
        m = m.select(F.col("ref_id").alias("child"), F.col("rel_id").alias("parent")).distinct()
        return m.join(ids.select(F.col("id").alias("child")), "child", "left_semi")

    def ways_using_node(self, node: int) -> DataFrame:
        return self.node_ways.where(F.col("child") == node).select(F.col("parent").alias("id"))

    def relations_with(self, etype: str, element: int) -> DataFrame:
        return self.parents(etype).where(F.col("child") == element).select(F.col("parent").alias("id"))

    def stored(self, pairs: DataFrame) -> DataFrame:
        """Pairs written in order of child, so that a lookup reads few row groups."""
        return materialize(pairs.repartitionByRange("child").sortWithinPartitions("child", "parent"), "backrefs")

    def page(self, node: int, first: int = 10) -> DataFrame:
        """what, id, label, more: the first ways and relations of a node, and how many there are beyond."""
        info = Taginfo(self.data)
        out = None
        for what, ids, etype in (("way", self.ways_using_node(node), "way"), ("relation", self.relations_with("node", node), "relation")):
            n = ids.count()
            r = ids.orderBy("id").limit(first)
            lab = info.labels(etype).join(F.broadcast(r), "id", "left_semi")
            part = r.join(lab, "id", "left").select(
                F.lit(what).alias("what"), "id", F.coalesce("label", F.lit("(no descriptive tags)")).alias("label"), F.lit(max(0, n - first)).alias("more"))
            out = part if out is None else out.unionByName(part)
        return out
