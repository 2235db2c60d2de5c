"""Checks of derived tables against the dataset: one row for each check, bad is the number of rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..functions import text as X
from ..model import KINDS, Dataset
from .backrefs import Backrefs
from .taginfo import Taginfo


def _bad(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")


def taginfo_checks(info: Taginfo) -> DataFrame:
    """Totals equal the tag rows, keys are the sum of their values, ranks are a right order, combinations fit and are symmetric."""
    t, v, k = info.tags, info.value_stats, info.key_stats
    total = t.agg(F.count(F.lit(1)).alias("n"))
    sums = v.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("m"))
    one = total.withColumn("j", F.lit(1)).join(sums.withColumn("j", F.lit(1)), "j")
    by_key = v.groupBy("key").agg(F.sum("total").alias("s"), F.count("value").alias("d"))
    ranks = info.values_by_count().withColumn("before", F.lag("total").over(Window.partitionBy("key").orderBy("rank")))
    ranks = ranks.withColumn("value_before", F.lag("value").over(Window.partitionBy("key").orderBy("rank")))
    sizes = t.groupBy("key").agg(F.count_distinct("etype", "id").alias("elements"))
    pairs = t.groupBy("key", "value").agg(F.count_distinct("etype", "id").alias("elements"))
    return (_bad("totals equal tag rows", one.where("n <> m"))
            .unionByName(_bad("keys sum their values", k.join(by_key, "key").where("total <> s or distinct_values <> d")))
            .unionByName(_bad("ranks ordered", ranks.where("before < total or (before = total and value_before > value)")))
            .unionByName(_combinations("combinations", info.key_combinations(), ["key"], sizes))
            .unionByName(_combinations("tag combinations", info.tag_combinations(), ["key", "value"], pairs)))


def _combinations(name: str, c: DataFrame, item: list[str], sizes: DataFrame) -> DataFrame:
    """Counts are the same seen from either side, and no greater than the elements that carry either item."""
    other = [f"other_{x}" for x in item]
    back = c.select(*(F.col(x).alias(o) for x, o in zip(item, other)), *(F.col(o).alias(x) for x, o in zip(item, other)), F.col("together_count").alias("back"))
    return (_bad(f"{name} symmetric", c.join(back, item + other, "left").where("back is null or back <> together_count"))
            .unionByName(_bad(f"{name} fit", c.join(sizes, item, "left").where("elements is null or together_count > elements"))))


def posting_checks(data: Dataset, postings: DataFrame, key_postings: DataFrame) -> DataFrame:
    """Stored postings are the dataset's tags, and key postings their elements by key, both ways."""
    tags, by_key = data.tags.select("etype", "id", "key", "value"), postings.select("etype", "key", "id").distinct()
    return (_bad("postings from tags", postings.select(*tags.columns).exceptAll(tags)).unionByName(_bad("tags have postings", tags.exceptAll(postings.select(*tags.columns))))
            .unionByName(_bad("key postings from postings", key_postings.select(*by_key.columns).exceptAll(by_key)))
            .unionByName(_bad("postings have key postings", by_key.exceptAll(key_postings.select(*by_key.columns)))))


def sampled_checks(data: Dataset, postings: DataFrame, share: int = 100) -> DataFrame:
    """Ground truth for one element in `share`, chosen by hash: its tags as read from the histories, row by row, are its postings."""
    from ..sources.tables import table

    chosen = F.pmod(F.xxhash64("etype", "id"), F.lit(share)) == 0
    raw = table(data.spark, data.root, "tags").where("slot is not null and key_idx is not null").where(chosen)
    w = Window.partitionBy("etype", "id", "key_idx").orderBy(F.desc_nulls_last("edited_at"), F.asc_nulls_last("loaded_at"))
    now = raw.withColumn("no", F.row_number().over(w)).where("no = 1")
    truth = now.join(table(data.spark, data.root, "tag_slots").select("slot", F.col("key").alias("k"), F.col("value").alias("v")), "slot").where("k is not null and v is not null").select("etype", "id", F.col("k").alias("key"), F.col("v").alias("value"))
    got = postings.where(chosen).select("etype", "id", "key", "value")
    return _bad("sampled elements have their tags", truth.exceptAll(got)).unionByName(_bad("sampled elements have no other tags", got.exceptAll(truth)))


def ring_checks(data: Dataset, rings: DataFrame) -> DataFrame:
    """Of rings (rel_id, polygon_no, ring_no, vertex_no, node_id, lon, lat): vertices are numbered from 0 without gaps, rings are
    closed, exactly or by a gap below that of seams, and nodes lie where the dataset has them."""
    ring = ["rel_id", "polygon_no", "ring_no"]
    at = lambda f: f(F.struct("lon", "lat"), F.col("vertex_no"))
    g = rings.groupBy(*ring).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vertex_no").alias("numbers"), F.min("vertex_no").alias("least"),
                                 F.max("vertex_no").alias("most"), at(F.min_by).alias("a"), at(F.max_by).alias("b"))
    gap = G.distance_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    places = data.nodes.select(F.col("id").alias("node_id"), G.degrees(F.col("lon")).alias("x"), G.degrees(F.col("lat")).alias("y"))
    return (_bad("vertices numbered", g.where("least <> 0 or most <> n - 1 or numbers <> n")).unionByName(_bad("rings closed", g.where(gap >= 250.0)))
            .unionByName(_bad("vertices at their nodes", rings.join(places, "node_id", "left").where("x is null or x <> lon or y <> lat")))
            .unionByName(_bad("polygons begin with their outer ring", g.groupBy("rel_id", "polygon_no").agg(F.min("ring_no").alias("first"), F.count(F.lit(1)).alias("n"), F.max("ring_no").alias("last")).where("first <> 0 or last <> n - 1"))))


def search_checks(info: Taginfo) -> DataFrame:
    """Every gram of the index occurs in its value, every value of three bytes or more is in the index."""
    i = info.value_trigrams()
    absent = i.where(~F.array_contains(X.trigrams(F.col("value")), F.col("gram")))
    long = info.data.dictionary.select("key", "value").distinct().where(F.octet_length("value") >= 3)
    return _bad("grams occur", absent).unionByName(_bad("values indexed", long.join(i.select("key", "value").distinct(), ["key", "value"], "left_anti")))


def backref_checks(data: Dataset, b: Backrefs) -> DataFrame:
    """Every pair comes from a reference, every resolved reference has its pair, pairs are distinct; of ways and of relations."""
    refs = data.way_refs.select(F.col("node_id").alias("child"), F.col("way_id").alias("parent"))
    out = _pairs("", b.node_ways, refs, data.nodes)
    for kind, (name, ids) in enumerate(zip(KINDS, (data.nodes, data.ways, data.relations))):
        m = data.members.where(F.col("kind") == kind).select(F.col("ref_id").alias("child"), F.col("rel_id").alias("parent"))
        out = out.unionByName(_pairs(f"{name} members: ", b.parents(name), m, ids))
    return out


def _pairs(name: str, pairs: DataFrame, refs: DataFrame, ids: DataFrame) -> DataFrame:
    refs = refs.join(ids.select(F.col("id").alias("child")), "child", "left_semi")
    twice = pairs.groupBy("child", "parent").count().where("count > 1").select("child", "parent")
    return (_bad(f"{name}pairs from references", pairs.join(refs, ["child", "parent"], "left_anti"))
            .unionByName(_bad(f"{name}references have pairs", refs.join(pairs, ["child", "parent"], "left_anti")))
            .unionByName(_bad(f"{name}pairs distinct", twice)))


def archive_checks(archive) -> DataFrame:
    """All checks of the parts that an archive has."""
    data, parts = archive.data, []
    if archive.taginfo is not None:
        parts += [taginfo_checks(archive.taginfo), sampled_checks(data, archive.read("postings"))]
        if archive.has_key_postings:
            parts.append(posting_checks(data, archive.read("postings"), archive.read("key_postings")))
        if archive.has_value_search:
            parts.append(search_checks(archive.taginfo))
    if archive.backrefs is not None:
        parts.append(backref_checks(data, archive.backrefs))
    if archive.multipolygons is not None:
        parts.append(ring_checks(data, archive.multipolygons))
    return reduce(DataFrame.unionByName, parts)
