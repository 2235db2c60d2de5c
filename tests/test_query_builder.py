import math

import pytest

from cartolith.functions.geom import Box
from cartolith.model import Dataset
from cartolith.operators.backrefs import Backrefs
from cartolith.operators.spatial import Spatial
from cartolith.operators.taginfo import Taginfo, from_maps
from cartolith.plans.query import InvalidSpatial, NoTags, Query, Selection, Unconstrained

BOX = (11.395, 47.261, 11.412, 47.273)


@pytest.fixture(scope="module")
def ds(spark, small_map):
    return Dataset(spark, small_map)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_places(ds):
    sp, box = Spatial(ds), Box(*BOX)
    assert ids(sp.nodes_in_bbox(box)) == [11, 12, 13, 15, 16] and ids(sp.ways_in_bbox(box)) == [20, 21, 22] and ids(sp.relations_in_bbox(box)) == [30, 32]
    assert ids(sp.in_bbox("node", Box(12, 48, 11, 47))) == []
    assert len(ids(sp.nodes_in_bbox(Box(-500, -500, 500, 500)))) == 7 and ids(sp.nodes_in_bbox(Box(181, 0, 500, 1))) == []
    at = (11.401, 47.266)
    near = sp.nearest("node", *at, 3).orderBy("d2", "id").collect()
    assert [r["id"] for r in near] == [11, 16, 12] and near[0]["d2"] == 0 and abs(near[2]["d2"] - 2 * 30_000**2) <= 200_000
    assert sp.nearest("node", math.nan, 0, 3).count() == 0 and sp.nearest("way", 0, 0, 0).count() == 0
    assert len(ids(sp.nearest("node", 0, 0, 50))) == 7
    assert ids(sp.within_radius("node", *at, 0.0)) == [11]
    assert ids(sp.within_radius("way", *at, 1e-7)) == [20]
    assert ids(sp.within_radius("relation", *at, 1e-7)) == [30]
    assert sp.within_radius("node", 0, 0, -1).count() == 0
    # relation 32 holds relation 30 and with it node 11; relation 31 has no box and never matches
    assert ids(sp.within_radius("relation", 11.4035, 47.2685, 0.01)) == [30, 32]
    assert ids(sp.nearest("relation", *at, 9)) == [30, 32]
    assert sorted(map(tuple, sp.closure().collect())) == [(30, 30), (31, 30), (31, 31), (32, 30), (32, 32)]


def test_backrefs(ds):
    b = Backrefs(ds)
    assert ids(b.ways_using_node(12)) == [20, 22] and ids(b.ways_using_node(77)) == []
    assert ids(b.relations_with("node", 11)) == [30] and ids(b.relations_with("way", 22)) == [32] and ids(b.relations_with("relation", 30)) == [31, 32]
    assert [tuple(r) for r in b.page(12, 1).collect()] == [("way", 20, "highway=path", 1)]
    assert [tuple(r) for r in b.page(15, 1).collect()] == [("way", 22, "amenity=bench", 0), ("relation", 32, "type=site", 0)]


def test_taginfo(ds):
    t = Taginfo(ds)
    combos = {(r["key"], r["other_key"]): r["together_count"] for r in t.key_combinations().collect()}
    assert combos["amenity", "name"] == 2 == combos["name", "amenity"]
    tags = {tuple(r)[:4]: r["together_count"] for r in t.tag_combinations().collect()}
    assert tags["amenity", "fountain", "name", "Brunn"] == 1
    assert ids(t.postings("way", "highway")) == [20, 21] and ids(t.postings("way", "shop")) == []
    assert [r["key"] for r in t.keys_with_prefix("am").collect()] == ["amenity"] and t.keys_with_prefix("").count() == t.keys().count()
    assert [(r["value"], r["total"]) for r in t.values_by_count("amenity").orderBy("rank").collect()] == [("bench", 5), ("fountain", 1), ("unused", 0)]
    maps = t.as_maps()
    assert from_maps(maps).count() == ds.tags.count()


def test_query(ds):
    q, (x0, y0, x1, y1) = Query(ds), BOX
    assert ids(q.with_tag("amenity", "bench").in_bbox(*BOX).nodes()) == [11, 12, 15]
    assert ids(q.with_key("highway").in_bbox(*BOX).ways()) == [20, 21]
    assert ids(q.with_key("type").within_radius(11.404, 47.269, 0.001).relations()) == [30, 32]
    assert ids(q.with_key("amenity").in_polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]).nodes()) == [11, 12, 15]
    assert ids(q.with_key("no such key").nodes()) == []


def test_query_errors(ds):
    q = Query(ds)
    with pytest.raises(Unconstrained):
        q.nodes()
    bad = [q.within_radius(0, 0, -1), q.within_radius(math.nan, 0, 1), q.in_polygon([(0, 0), (1, 1)]), q.in_bbox(1, 0, 0, 1), q.in_bbox(0, 0, math.inf, 1)]
    for b in bad:
        with pytest.raises(InvalidSpatial):
            b.with_key("highway").ways()
    with pytest.raises(InvalidSpatial):
        Query(ds, has_tags=False).with_key("x").within_radius(0, 0, -1).nodes()
    with pytest.raises(NoTags):
        Query(ds, has_tags=False).with_key("x").nodes()


def test_selection(ds):
    assert ids(Selection(ds, "node").and_("amenity", "bench").and_("name").resolve()) == [12]
    assert Selection(ds, "node").in_bbox(Box(*BOX)).resolve().count() == 0
