import pytest

from cartolith import cli
from cartolith.functions import geom as G
from cartolith.model import Dataset
from cartolith.operators.spatial import Spatial
from cartolith.operators.taginfo import Taginfo
from cartolith.plans import catalog
from cartolith.sources.tables import SchemaError
from cartolith.sources.store import Archive, BuildError, BuildOptions, Mismatch, build, fingerprint, verify


@pytest.fixture(scope="module")
def built(spark, small_map, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("ext"))
    ds = Dataset(spark, small_map, {"replication": 7})
    build(ds, out, BuildOptions.everything())
    return ds, out


def test_open(built):
    ds, out = built
    a = Archive.open(ds, out)
    assert a.has_key_postings and a.has_value_search and a.land_polygons is None and a.coastline is not None
    assert sorted(r["id"] for r in a.backrefs.ways_using_node(12).collect()) == [20, 22]
    live = Taginfo(ds)
    for name in ("value_stats", "key_stats"):
        assert sorted(map(tuple, getattr(a.taginfo, name).collect())) == sorted(map(tuple, getattr(live, name).collect()))
    assert sorted(r["id"] for r in a.query().with_key("highway").ways().collect()) == [20, 21]


def test_lookups_by_id(built):
    a = Archive.open(*built)
    assert [a.index_of("node", i) for i in range(10, 17)] == list(range(7)) and a.index_of("way", 5) is None
    assert a.id_of("relation", 2) == 32 and a.id_of("relation", 3) is None
    vs = a.read("value_stats").orderBy("key", "value").collect()
    assert [r["value_index"] for r in vs] == list(range(len(vs)))


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


@pytest.fixture(scope="module")
def real(spark, data_dir, tmp_path_factory):
    out, ds = str(tmp_path_factory.mktemp("real")), Dataset(spark, data_dir)
    build(ds, out, BuildOptions(combinations=True, key_postings=True, value_search=True, places=True))
    return ds, Archive.open(ds, out)


SHAPES = {"disc": (G.Radius, *catalog.CENTER, catalog.RADIUS), "polygon": (G.Polygon, catalog.TRIANGLE), "point": (G.Radius, *catalog.CENTER, 0.0), "bad": (G.Radius, 0, 0, -1), "world": (G.Radius, 0.0, 0.0, 400.0)}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("etype", ["node", "way", "relation"])
def test_stored_places(real, etype, shape):
    ds, a = real
    make, *of = SHAPES[shape]
    assert rows(a.spatial.touching(etype, make(*of))) == rows(Spatial(ds).touching(etype, make(*of)))


@pytest.mark.parametrize("etype", ["node", "way", "relation"])
def test_stored_distances(real, etype):
    ds, a = real
    live, box = Spatial(ds), G.Box(*catalog.BOX)
    assert rows(a.spatial.within_radius(etype, *catalog.CENTER, 0.1)) == rows(live.within_radius(etype, *catalog.CENTER, 0.1))
    assert rows(a.spatial.nearest(etype, *catalog.CENTER, 9)) == rows(live.nearest(etype, *catalog.CENTER, 9))
    assert rows(a.spatial.in_bbox(etype, box)) == rows(live.in_bbox(etype, box))


def test_stored_tags(real):
    ds, a = real
    live, info, box = Taginfo(ds), a.taginfo, G.Box(*catalog.BOX)
    for ask in (lambda t: t.keys(), lambda t: t.kv(catalog.KEY, catalog.VALUE), lambda t: t.values(catalog.KEY), lambda t: t.key_stats, lambda t: t.values_by_count(), lambda t: t.values_by_count("name", 4),
                lambda t: t.postings("way", catalog.KEY), lambda t: t.postings("way", catalog.KEY, catalog.VALUE), lambda t: t.postings_in_bbox("node", catalog.KEY2, box), lambda t: t.counts_within(box),
                lambda t: t.key_combinations(), lambda t: t.tag_combinations(), lambda t: t.values_containing("PLACE"), lambda t: t.values_containing("of", "name"), lambda t: t.search_ranked("place", 7),
                lambda t: t.value_trigrams(), lambda t: t.labels("way"), lambda t: t.key_page("name", 3)):
        assert rows(ask(info)) == rows(ask(live))


def test_stored_plans(real):
    _, a = real
    plan = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    ways = plan(a.spatial.within_radius("way", *catalog.CENTER, catalog.RADIUS))
    assert "Or(GreaterThanOrEqual(ax" in ways and "GreaterThanOrEqual(max_lon" in ways and "way_refs" not in ways
    nodes = plan(a.query().in_bbox(*catalog.BOX).nodes())
    assert "GreaterThanOrEqual(lon" in nodes and "visible" not in nodes
    assert "EqualTo(key,highway)" in plan(a.query().with_tag("highway", "lane").ways())
    assert "In(gram" in plan(a.taginfo.values_containing("harbour")).replace("InSet", "In")


@pytest.mark.parametrize("what", ["schema", "nodes", "ways", "relations", "tags", "strings", "replication"])
def test_stale(built, what):
    ds, _ = built
    now = fingerprint(ds).first().asDict()
    verify(now, ds)
    with pytest.raises(Mismatch) as e:
        verify(now | {what: "other"}, ds)
    assert e.value.what == what


def test_wrong_tables_are_named(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id bigint, lon string").write.parquet(f"{tmp_path}/nodes.parquet")
    with pytest.raises(SchemaError, match="nodes.lon should be double, is string"):
        Dataset(spark, str(tmp_path)).nodes  # noqa: B018
    spark.createDataFrame([(1, 2.0)], "id bigint, way_id double").write.parquet(f"{tmp_path}/ways.parquet")
    with pytest.raises(SchemaError, match="ways.visible"):
        Dataset(spark, str(tmp_path)).ways  # noqa: B018


def test_polygons_of_a_relation(built):
    a = Archive.open(*built)
    assert a.polygons(30) == []
    a._tables["multipolygons"] = a.spark.createDataFrame(
        [(5, p, r, v, v, float(p), float(v)) for p, r, n in ((0, 0, 4), (0, 1, 3), (1, 0, 3)) for v in reversed(range(n))], "rel_id bigint, polygon_no int, ring_no int, vertex_no int, node_id bigint, lon double, lat double")
    assert [[len(r) for r in p] for p in a.polygons(5)] == [[4, 3], [3]] and a.polygons(5)[1][0] == [(1.0, 0.0), (1.0, 1.0), (1.0, 2.0)] and a.polygons(6) == []


def test_classify_command(built, capsys):
    assert cli.main([built[0].root, "--classify", "11.4", "47.27", "--classify", "0", "0"]) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["11.4 47.27 water", "0.0 0.0 water"]


def test_nothing_to_build(built, tmp_path):
    ds, _ = built
    with pytest.raises(BuildError):
        build(ds, str(tmp_path / "x"), BuildOptions())
    with pytest.raises(BuildError):
        Archive.open(ds, str(tmp_path / "x"))
    assert cli.main([str(tmp_path)]) == 2
