"""Derived tables on storage: build, fingerprint, open, and the capabilities present."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zcurve as Z
from ..model import SCALE, Dataset, degrees
from ..operators import rings as R
from ..operators.backrefs import Backrefs
from ..operators.setops import numbered
from ..operators.spatial import Spatial
from ..operators.taginfo import Taginfo
from ..plans.query import Query

FORMAT = 2


class BuildError(Exception):
    """A build that could not start or be written."""


class Mismatch(Exception):
    """Derived tables that belong to another dataset. what: schema, nodes, ways, relations, tags, strings or replication."""

    def __init__(self, what: str, ours, theirs):
        super().__init__(f"{what}: the dataset has {theirs}, the derived tables were built for {ours}")
        self.what = what


@dataclass(frozen=True)
class BuildOptions:
    """What to build. tags is built whenever combinations, key_postings or value_search are.

    places: current nodes, segments and boxes of ways along the Z-order curve,
    and what every relation reaches, for spatial searches.
    """

    tags: bool = False
    combinations: bool = False
    key_postings: bool = False
    value_search: bool = False
    places: bool = False
    backrefs: bool = False
    multipolygons: bool = False
    coastline: bool = False
    land_polygons: str | None = None

    @classmethod
    def everything(cls) -> BuildOptions:
        return cls(**{f.name: True for f in fields(cls) if f.name != "land_polygons"})

    def any(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))


def schema_hash() -> str:
    cols = {n: sorted(v) for n, v in {
        "nodes": ["id", "lon", "lat"], "way_refs": ["way_id", "pos", "node_id"], "relations": ["id", "min_lon", "min_lat", "max_lon", "max_lat"],
        "members": ["rel_id", "pos", "kind", "ref_id", "role"], "tags": ["etype", "id", "key", "value"], "format": [str(FORMAT)]}.items()}
    return hashlib.sha256(json.dumps(cols, sort_keys=True).encode()).hexdigest()


def fingerprint(data: Dataset) -> DataFrame:
    """One row: schema, nodes, ways, relations, tags (distinct pairs), strings (bytes of distinct strings), replication."""
    d = data.dictionary
    strings = d.select(F.col("key").alias("s")).unionByName(d.select(F.col("value").alias("s"))).distinct()
    one = lambda df, name, c=F.count(F.lit(1)): df.agg(c.alias(name)).withColumn("one", F.lit(1))
    out = one(data.nodes, "nodes")
    for part in (one(data.ways, "ways"), one(data.relations, "relations"), one(d.select("key", "value").distinct(), "tags"),
                 one(strings, "strings", F.coalesce(F.sum(F.octet_length("s")), F.lit(0)))):
        out = out.join(part, "one")
    rep = F.lit(data.properties.get("replication")).cast("bigint")
    return out.select(F.lit(schema_hash()).alias("schema"), "nodes", "ways", "relations", "tags", "strings", rep.alias("replication"))


CHECKED = ("schema", "nodes", "ways", "relations", "tags", "strings", "replication")


def verify(stored: dict, data: Dataset) -> None:
    """Raises Mismatch at the first part that differs, in the order of CHECKED."""
    now = fingerprint(data).first().asDict()
    for what in CHECKED:
        if stored.get(what) != now[what]:
            raise Mismatch(what, stored.get(what), now[what])


def build(data: Dataset, out: str, options: BuildOptions) -> None:
    """Writes the derived tables that options name, the manifest last, so that an interrupted build is not opened.

    Tables are laid out for their lookups: pairs by child, postings by key and
    value, trigrams by gram.
    """
    if not options.any():
        raise BuildError("nothing to build")

    def write(df: DataFrame, name: str, by: list[str] | None = None) -> None:
        df = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")

    def along(df: DataFrame, code: Column, name: str) -> None:
        """In order of the curve: a box's rows then lie in few row groups, whose bounds on each coordinate leave out the others."""
        cols = df.columns
        df = df.withColumn("_code", code).repartitionByRange("_code").sortWithinPartitions("_code").select(*cols)
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{out}/{name}")

    info = Taginfo(data)
    if options.tags or options.combinations or options.key_postings or options.value_search:
        write(info.key_stats, "key_stats", ["key"])
        write(info.values_by_count(), "values_by_count", ["key", "rank"])
        write(info.value_stats.join(info.value_index(), ["key", "value"]), "value_stats", ["key", "value"])
        write(data.tags, "postings", ["key", "value", "etype", "id"])
    if options.combinations:
        write(info.key_combinations(), "key_combinations", ["key"])
        write(info.tag_combinations(), "tag_combinations", ["key", "value"])
    if options.key_postings:
        write(data.tags.select("etype", "key", "id").distinct(), "key_postings", ["key", "etype", "id"])
    if options.value_search:
        write(info.value_trigrams(), "value_trigrams", ["gram", "key", "value"])
    if options.places:
        sp = Spatial(data)
        curve = lambda x, y: Z.cell(degrees(x), degrees(y), Z.MAX_LEVEL)
        along(data.nodes, curve(F.col("lon"), F.col("lat")), "nodes")
        along(sp.segments, curve((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2), "segments")
        along(sp.way_boxes, curve((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2), "way_boxes")
        write(data.relations, "relations", ["id"])
        write(data.members, "members", ["rel_id", "pos"])
        write(sp.closure(), "relation_reach", ["rel_id", "reach"])
        for kind, ids in (("node", data.nodes), ("way", data.ways), ("relation", data.relations)):
            write(numbered(ids.select("id"), ["id"], "idx"), f"{kind}_ids", ["id"])
    if options.backrefs:
        b = Backrefs(data)
        write(b.node_ways, "node_ways", ["child", "parent"])
        for kind in ("node", "way", "relation"):
            write(b.parents(kind), f"{kind}_relations", ["child", "parent"])
    if options.multipolygons:
        write(R.multipolygons(data), "multipolygons", ["rel_id", "polygon_no", "ring_no", "vertex_no"])
    if options.coastline:
        write(R.coastline(data), "coastline", ["part", "ring_no", "vertex_no"])
    if options.land_polygons:
        from ..functions.geom import Box
        from .shapefile import read_polygons

        world = data.nodes.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        box = Box(*(c / SCALE for c in world)) if world[0] is not None else Box(0, 0, 0, 0)
        write(R.land_rings(read_polygons(data.spark, options.land_polygons), box), "land_polygons")
    fingerprint(data).withColumn("built_by", F.lit(f"cartolith {FORMAT}")).coalesce(1).write.mode("overwrite").parquet(f"{out}/_manifest_table")


class Stored(Dataset):
    """A dataset whose tables come from the derived ones where these were built."""

    def __init__(self, archive: Archive):
        super().__init__(archive.data.spark, archive.data.root, archive.data.properties)
        self._archive = archive

    def _or(self, name: str, table: str) -> DataFrame:
        got = self._archive.read(table)
        return getattr(self._archive.data, name) if got is None else got

    @cached_property
    def nodes(self) -> DataFrame:
        return self._or("nodes", "nodes")

    @cached_property
    def relations(self) -> DataFrame:
        return self._or("relations", "relations")

    @cached_property
    def members(self) -> DataFrame:
        return self._or("members", "members")

    @cached_property
    def tags(self) -> DataFrame:
        return self._or("tags", "postings")

    @cached_property
    def dictionary(self) -> DataFrame:
        got = self._archive.read("value_stats")
        return self._archive.data.dictionary if got is None else got.select(F.col("value_index").alias("slot"), "key", "value")


class StoredPlaces(Spatial):
    """Spatial searches over stored nodes, segments, boxes and reach."""

    def __init__(self, archive: Archive):
        super().__init__(archive.stored)
        self.segments, self.way_boxes, self._reach = (archive.read(t) for t in ("segments", "way_boxes", "relation_reach"))

    def _ways(self, shape, *more) -> DataFrame:
        """Only segments near the shape are read, and of boxes only those that meet its box."""
        hit = self._hit_segments(shape).groupBy(F.col("way_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"), *more)
        return hit.join(self.ways_in_bbox(shape.box), "id", "left_semi")

    def relation_parts(self, roots: DataFrame) -> DataFrame:
        seen = self._reach.select(F.col("rel_id").alias("root"), F.col("reach").alias("rel"))
        return self._parts_of(seen.join(roots.select(F.col("id").alias("root")), "root", "left_semi"))

    def closure(self) -> DataFrame:
        return self._reach


class StoredTaginfo(Taginfo):
    """Lookups over stored counts, postings, combinations and grams."""

    def __init__(self, archive: Archive):
        super().__init__(archive.stored, space=archive.spatial)
        self._read = archive.read
        self.value_stats, self.key_stats = archive.read("value_stats").drop("value_index"), archive.read("key_stats")

    def value_index(self) -> DataFrame:
        return self._read("value_stats").select("key", "value", "value_index")

    def values_by_count(self, key: str | None = None, first: int | None = None) -> DataFrame:
        r = self._read("values_by_count")
        r = r if key is None else r.where(F.col("key") == key)
        return r if first is None else r.where(F.col("rank") <= first)

    def postings(self, etype: str, key: str, value: str | None = None) -> DataFrame:
        ids = self._read("key_postings") if value is None else None
        return super().postings(etype, key, value) if ids is None else ids.where((F.col("key") == key) & (F.col("etype") == etype)).select("id")

    def key_combinations(self) -> DataFrame:
        got = self._read("key_combinations")
        return super().key_combinations() if got is None else got

    def tag_combinations(self) -> DataFrame:
        got = self._read("tag_combinations")
        return super().tag_combinations() if got is None else got

    def value_trigrams(self) -> DataFrame:
        got = self._read("value_trigrams")
        return super().value_trigrams() if got is None else got

    def values_containing(self, pattern: str, key: str | None = None) -> DataFrame:
        index = self._read("value_trigrams")
        return super().values_containing(pattern, key) if index is None else self.trigram_search(pattern, index, key)


class Archive:
    """A dataset with its derived tables; parts that were not built are None."""

    def __init__(self, data: Dataset, root: str):
        self.data, self.root, self.spark = data, root, data.spark
        self._tables: dict[str, DataFrame | None] = {}

    @classmethod
    def open(cls, data: Dataset, root: str, check: bool = True) -> Archive:
        a = cls(data, root)
        manifest = a.read("_manifest_table")
        if manifest is None:
            raise BuildError(f"no finished build in {root}")
        if check:
            verify(manifest.first().asDict(), data)
        return a

    def read(self, name: str) -> DataFrame | None:
        if name not in self._tables:
            try:
                self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                self._tables[name] = None
        return self._tables[name]

    @cached_property
    def stored(self) -> Stored:
        return Stored(self)

    @cached_property
    def taginfo(self) -> Taginfo | None:
        """Lookups over the stored tables where there are any."""
        return None if self.read("value_stats") is None else StoredTaginfo(self)

    @property
    def has_key_postings(self) -> bool:
        return self.read("key_postings") is not None

    @property
    def has_value_search(self) -> bool:
        return self.read("value_trigrams") is not None

    @cached_property
    def backrefs(self) -> Backrefs | None:
        pairs = self.read("node_ways")
        if pairs is None:
            return None
        b = Backrefs(self.stored)
        b.node_ways = pairs
        b.parents = {k: self.read(f"{k}_relations") for k in ("node", "way", "relation")}.get
        return b

    @property
    def multipolygons(self) -> DataFrame | None:
        return self.read("multipolygons")

    def polygons(self, relation: int) -> list[list[list[tuple[float, float]]]]:
        """Polygons of one relation: of each its rings, the outer first, as places in order. None stored or none closed: an empty list."""
        rows = self.multipolygons
        if rows is None:
            return []
        out: list[list[list[tuple[float, float]]]] = []
        ring = None
        for r in rows.where(F.col("rel_id") == relation).orderBy("polygon_no", "ring_no", "vertex_no").collect():
            if (r["polygon_no"], r["ring_no"]) != ring:
                if ring is None or r["polygon_no"] != ring[0]:
                    out.append([])
                out[-1].append([])
                ring = (r["polygon_no"], r["ring_no"])
            out[-1][-1].append((r["lon"], r["lat"]))
        return out

    @property
    def coastline(self) -> DataFrame | None:
        return self.read("coastline")

    @property
    def land_polygons(self) -> DataFrame | None:
        """is_land, points of the imported rings, greatest area first."""
        rings = self.read("land_polygons")
        return None if rings is None else R.land_ring_degrees(rings)

    def _one(self, etype: str, known: str, value: int, wanted: str) -> int | None:
        ids = self.read(f"{etype}_ids")
        if ids is None:
            raise BuildError("no places were built")
        row = ids.where(F.col(known) == value).select(wanted).first()
        return row and row[0]

    def index_of(self, etype: str, element: int) -> int | None:
        """Place of an element among those of its type in order of id, from 0; None if there is no such element."""
        return self._one(etype, "id", element, "idx")

    def id_of(self, etype: str, index: int) -> int | None:
        """The id at a place; the inverse of index_of."""
        return self._one(etype, "idx", index, "id")

    @cached_property
    def spatial(self) -> Spatial:
        """Over stored places where they were built."""
        return Spatial(self.stored) if self.read("segments") is None else StoredPlaces(self)

    def query(self) -> Query:
        """Always there; asking it for tags raises NoTags where none were built."""
        return Query(self.stored, has_tags=self.taginfo is not None, info=self.taginfo, space=self.spatial)
