"""Queries of the map operators, over a whole dataset each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom as G
from ..model import KINDS, Dataset
from ..operators import rings as R
from ..operators import setops, verify
from ..operators.backrefs import Backrefs
from ..operators.shore import classify_points
from ..operators.spatial import Spatial
from ..operators.taginfo import Taginfo, shared_index
from ..session import scratch
from ..sources.store import Archive, BuildError, BuildOptions, build, fingerprint
from .query import Query, Selection

CENTER, RADIUS, NEAREST = (-36.32, 10.72), 0.05, 25
BOX = (-36.45, 10.65, -36.25, 10.85)
#: A box that reaches beyond the world.
BEYOND = (-36.3, 10.7, 400.0, 300.0)
TRIANGLE = [(-36.42, 10.66), (-36.22, 10.70), (-36.30, 10.86)]
KEY, VALUE, KEY2 = "highway", "lane", "source"
PATTERN, PREFIX = "place", "addr:"
SHORE = ("highway", "lane")

_box = G.Box(*BOX)
_info = lambda s, d: Taginfo(Dataset(s, d))
_space = lambda s, d: Spatial(Dataset(s, d))
_back = lambda s, d: Backrefs(Dataset(s, d))


def _typed(make) -> DataFrame:
    """Union over element types, with the type."""
    out = None
    for k in KINDS:
        part = make(k).select(F.lit(k).alias("etype"), "id")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    # tag inventory
    "keys": lambda s, d: _info(s, d).keys(),
    "key_lookup": lambda s, d: _info(s, d).key(KEY),
    "keys_with_prefix": lambda s, d: _info(s, d).keys_with_prefix(PREFIX),
    "kv_lookup": lambda s, d: _info(s, d).kv(KEY, VALUE),
    "values_of_key": lambda s, d: _info(s, d).values(KEY),
    "key_stats": lambda s, d: _info(s, d).key_stats,
    "value_stats": lambda s, d: _info(s, d).value_stats,
    "value_index": lambda s, d: _info(s, d).value_index(),
    "values_by_count": lambda s, d: _info(s, d).values_by_count(),
    "values_by_count_of_key": lambda s, d: _info(s, d).values_by_count(KEY, 10),
    "top_keys": lambda s, d: _info(s, d).top_keys(15),
    "kv_postings": lambda s, d: _typed(lambda k: _info(s, d).postings(k, KEY, VALUE)),
    "key_any_postings": lambda s, d: _typed(lambda k: _info(s, d).postings(k, KEY)),
    "kv_in_bbox": lambda s, d: _typed(lambda k: _info(s, d).postings_in_bbox(k, KEY, _box, VALUE)),
    "key_in_bbox": lambda s, d: _typed(lambda k: _info(s, d).postings_in_bbox(k, KEY, _box)),
    "counts_within": lambda s, d: _info(s, d).counts_within(_box),
    "value_tallies_within": lambda s, d: _info(s, d).value_tallies_within(_box),
    "key_combos": lambda s, d: _info(s, d).key_combinations(),
    "tag_combos": lambda s, d: _info(s, d).tag_combinations(),
    "kv_examples": lambda s, d: _info(s, d).examples(KEY, VALUE, 5),
    "key_page": lambda s, d: _info(s, d).key_page(KEY, 5),
    "key_combo_page": lambda s, d: _info(s, d).combination_page(KEY, 8),
    "tag_combo_page": lambda s, d: _info(s, d).combination_page(KEY, 8, VALUE),
    "way_labels": lambda s, d: _info(s, d).labels("way"),
    # text search
    "substring_all": lambda s, d: _info(s, d).values_containing(PATTERN),
    "substring_in_key": lambda s, d: _info(s, d).values_containing("HOF", "name"),
    "substring_non_ascii": lambda s, d: _info(s, d).values_containing("Ñe"),
    "value_trigrams": lambda s, d: _info(s, d).value_trigrams(),
    "trigram_search": lambda s, d: trigram_search(s, d),
    "search_ranked": lambda s, d: _info(s, d).search_ranked(PATTERN, 20),
    # sets of ids
    "postings_intersect": lambda s, d: setops.intersect([_info(s, d).postings("way", KEY), _info(s, d).postings("way", KEY2)]),
    "postings_union": lambda s, d: setops.union([_info(s, d).postings("way", KEY), _info(s, d).postings("way", KEY2)]),
    "id_ranges": lambda s, d: setops.id_ranges(Dataset(s, d).ways),
    "ids_within_ranges": lambda s, d: setops.within_ranges(_info(s, d).postings("way", KEY), setops.id_ranges(_space(s, d).ways_in_bbox(_box))),
    "selection": lambda s, d: Selection(Dataset(s, d), "way").and_(KEY, VALUE).and_(KEY2).in_bbox(_box).resolve(),
    # reverse references
    "ways_using_node": lambda s, d: _back(s, d).node_ways,
    "rels_with_node": lambda s, d: _back(s, d).parents("node"),
    "rels_with_way": lambda s, d: _back(s, d).parents("way"),
    "rels_with_relation": lambda s, d: _back(s, d).parents("relation"),
    "backrefs_page": lambda s, d: backrefs_page(s, d),
    # places
    "nodes_bbox": lambda s, d: _space(s, d).nodes_in_bbox(_box),
    "nodes_bbox_beyond": lambda s, d: _space(s, d).nodes_in_bbox(G.Box(*BEYOND)),
    "rels_bbox_beyond": lambda s, d: _space(s, d).relations_in_bbox(G.Box(*BEYOND)),
    "ways_bbox": lambda s, d: _space(s, d).ways_in_bbox(_box),
    "rels_bbox": lambda s, d: _space(s, d).relations_in_bbox(_box),
    "nodes_radius": lambda s, d: _space(s, d).within_radius("node", *CENTER, RADIUS),
    "ways_radius": lambda s, d: ranked(_space(s, d).within_radius("way", *CENTER, RADIUS)),
    "rels_radius": lambda s, d: ranked(_space(s, d).within_radius("relation", *CENTER, RADIUS)),
    "nodes_knn": lambda s, d: _space(s, d).nearest("node", *CENTER, NEAREST),
    "ways_knn": lambda s, d: ranked(_space(s, d).nearest("way", *CENTER, NEAREST)),
    "rels_knn": lambda s, d: ranked(_space(s, d).nearest("relation", *CENTER, NEAREST)),
    "nodes_polygon": lambda s, d: _space(s, d).nodes_touching(G.Polygon(TRIANGLE)),
    "ways_polygon": lambda s, d: _space(s, d).ways_touching(G.Polygon(TRIANGLE)),
    "rels_polygon": lambda s, d: _space(s, d).relations_touching(G.Polygon(TRIANGLE)),
    "relation_closure": lambda s, d: _space(s, d).closure(),
    # combined queries
    "query_tag_key_radius": lambda s, d: Query(Dataset(s, d)).with_tag(KEY, VALUE).with_key(KEY2).within_radius(*CENTER, RADIUS).ways(),
    "query_tag_polygon": lambda s, d: Query(Dataset(s, d)).with_key(KEY2).in_polygon(TRIANGLE).nodes(),
    "query_multi_bbox": lambda s, d: Query(Dataset(s, d)).in_bbox(*BOX).in_bbox(-36.35, 10.7, -36.2, 10.9).with_key("type").relations(),
    # rings
    "multipolygon_rings": lambda s, d: R.multipolygons(Dataset(s, d)).select("rel_id", "polygon_no", "ring_no", "vertex_no", "node_id"),
    "coastline_rings": lambda s, d: R.coastline(Dataset(s, d), *SHORE).select("part", "ring_no", "closed", "vertex_no", "node_id"),
    "coastline_land_water": lambda s, d: land_water(s, d),
    "coastline_window": lambda s, d: R.rings_in_window(R.coastline(Dataset(s, d), *SHORE), _box),
    "land_water_points": lambda s, d: classify_points(_degrees(s, d), R.shore_segments(Dataset(s, d), *SHORE)),
    "shore_ray_crossings": lambda s, d: R.ray_crossings(_degrees(s, d), R.shore_segments(Dataset(s, d), *SHORE)).withColumn("crossing_lon", F.round("crossing_lon", 7)),
    "ring_signed_area": lambda s, d: ring_areas(s, d),
    "mercator_to_wgs84": lambda s, d: mercator(s, d),
    # the same over stored tables
    "stored_query": lambda s, d: stored(s, d).query().with_tag(KEY, VALUE).with_key(KEY2).within_radius(*CENTER, RADIUS).ways(),
    "stored_substring": lambda s, d: stored(s, d).taginfo.values_containing(PATTERN),
    "stored_ways_radius": lambda s, d: ranked(stored(s, d).spatial.within_radius("way", *CENTER, RADIUS)),
    "stored_rels_radius": lambda s, d: ranked(stored(s, d).spatial.within_radius("relation", *CENTER, RADIUS)),
    "stored_ways_bbox": lambda s, d: stored(s, d).spatial.ways_in_bbox(_box),
    # lifecycle and checks
    "fingerprint": lambda s, d: fingerprint(Dataset(s, d)).drop("schema", "replication"),
    "verify_taginfo": lambda s, d: verify.taginfo_checks(_info(s, d)),
    "verify_search": lambda s, d: verify.search_checks(_info(s, d)),
    "verify_rings": lambda s, d: verify.ring_checks(Dataset(s, d), R.multipolygons(Dataset(s, d))),
    "verify_backrefs": lambda s, d: verify.backref_checks(Dataset(s, d), _back(s, d)),
}


_built: dict[tuple, str] = {}


def stored(spark: SparkSession, d: str) -> Archive:
    """The dataset with derived tables, built once a session into the shared folder."""
    data, key = Dataset(spark, d), (spark.sparkContext.applicationId, d)
    if key in _built:
        try:
            return Archive.open(data, _built[key], check=False)
        except BuildError:  # released
            pass
    _built[key] = scratch(spark, "ext")
    build(data, _built[key], BuildOptions(tags=True, key_postings=True, value_search=True, places=True))
    return Archive.open(data, _built[key], check=False)


def ranked(found: DataFrame) -> DataFrame:
    """id and distance in units, rounded, as squares beyond 2**53 differ in their last digits."""
    return found.select("id", F.round(F.sqrt("d2")).cast("bigint").alias("distance"))


def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    """A search by the index, written for it as for any number of searches."""
    info = _info(spark, d)
    return info.trigram_search(PATTERN, shared_index(info))


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(spark, d).nodes.select("id", G.degrees(F.col("lon")).alias("lon"), G.degrees(F.col("lat")).alias("lat"))


def land_water(spark: SparkSession, d: str) -> DataFrame:
    """Closed rings of the shore: land or water, area to a tenth of a square metre, and node ids in order."""
    rings = R.land_and_water(R.coastline(Dataset(spark, d), *SHORE))
    return rings.select("is_land", F.round("area_m2", 1).alias("area_m2"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), "/").alias("nodes"))


def backrefs_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of the node with the smallest id among those in ways."""
    b = _back(spark, d)
    node = b.node_ways.agg(F.min("child")).first()[0]
    return b.page(-1 if node is None else node, 3)


def ring_areas(spark: SparkSession, d: str) -> DataFrame:
    """rel_id, ring_no and signed area of the rings as once assembled, to a tenth of a square metre."""
    from ..sources.tables import current, table

    v = current(table(spark, d, "ring_vertices"), ["rel_id", "ring_no", "vertex_no"], ["lon", "lat"]).where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    g = v.groupBy("rel_id", "ring_no").agg(F.array_sort(F.collect_list(F.struct("vertex_no", "lon", "lat"))).alias("vs"))
    ps = F.transform("vs", lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))
    return g.select("rel_id", "ring_no", F.size("vs").alias("vertices"), F.round(G.ring_area_m2(ps), 1).alias("area_m2"))


def mercator(spark: SparkSession, d: str) -> DataFrame:
    """id and place of the nodes' units read as metres of EPSG:3857 / 100, to six digits."""
    n = Dataset(spark, d).nodes
    return n.select("id", F.round(G.mercator_lon(F.col("lon") / 100.0), 6).alias("lon"), F.round(G.mercator_lat(F.col("lat") / 100.0), 6).alias("lat"))
