"""Each check finds the violation that is planted for it, and none in what is built."""

import pytest
from pyspark.sql import functions as F

from cartolith.model import Dataset
from cartolith.operators import verify as V
from cartolith.operators.backrefs import Backrefs
from cartolith.operators.taginfo import Taginfo
from cartolith.sources.store import Archive, BuildOptions, build


@pytest.fixture(scope="module")
def ds(spark, small_map):
    return Dataset(spark, small_map)


def bad(df):
    return {r["check"] for r in df.collect() if r["bad"]}


def test_archive(spark, data_dir, tmp_path):
    data = Dataset(spark, data_dir)
    build(data, str(tmp_path), BuildOptions(combinations=True, key_postings=True, value_search=True, backrefs=True, multipolygons=True))
    got = V.archive_checks(Archive.open(data, str(tmp_path))).collect()
    assert len(got) == len({r["check"] for r in got}) == 31 and not [r for r in got if r["bad"]]


def with_(info, **parts):
    for name, df in parts.items():
        setattr(info, name, df if name.endswith("_stats") else lambda df=df: df)
    return info


def test_counts(ds):
    t = Taginfo(ds)
    more = lambda df: df.withColumn("total", F.col("total") + F.when(F.col("key") == "amenity", 1).otherwise(0))
    assert bad(V.taginfo_checks(with_(Taginfo(ds), value_stats=more(t.value_stats), key_stats=t.key_stats))) >= {"totals equal tag rows", "keys sum their values"}
    assert bad(V.taginfo_checks(with_(Taginfo(ds), key_stats=more(t.key_stats)))) == {"keys sum their values"}
    assert bad(V.taginfo_checks(with_(Taginfo(ds), values_by_count=t.values_by_count().withColumn("rank", -F.col("rank"))))) == {"ranks ordered"}
    for name, one in (("key_combinations", "combinations"), ("tag_combinations", "tag combinations")):
        c = getattr(t, name)()
        assert bad(V.taginfo_checks(with_(Taginfo(ds), **{name: c.where("key <> 'amenity'")}))) == {f"{one} symmetric"}
        assert bad(V.taginfo_checks(with_(Taginfo(ds), **{name: c.withColumn("together_count", F.col("together_count") + 100)}))) == {f"{one} fit"}


def test_search(spark, ds):
    t = Taginfo(ds)
    i = t.value_trigrams()
    # 0x162636 lies across the bytes of abcd, 0x616263 and 0x626364 are its grams
    odd = spark.createDataFrame([(0x162636, "name", "abcd")], i.schema)
    assert bad(V.search_checks(with_(Taginfo(ds), value_trigrams=i.unionByName(odd)))) == {"grams occur"}
    right = spark.createDataFrame([(0x616263, "name", "abcd"), (0x626364, "name", "ABCD")], i.schema)
    assert bad(V.search_checks(with_(Taginfo(ds), value_trigrams=i.unionByName(right)))) == set()
    assert bad(V.search_checks(with_(Taginfo(ds), value_trigrams=i.where("value <> 'bench'")))) == {"values indexed"}


def test_postings(ds):
    p = ds.tags
    k = p.select("etype", "key", "id").distinct()
    assert bad(V.posting_checks(ds, p, k)) == set() == bad(V.sampled_checks(ds, p, 1))
    assert bad(V.posting_checks(ds, p.unionByName(p.limit(1)), k)) == {"postings from tags"}
    assert bad(V.posting_checks(ds, p.where("value <> 'bench'"), k)) >= {"tags have postings", "key postings from postings"}
    assert bad(V.posting_checks(ds, p, k.where("key <> 'shop'"))) == {"postings have key postings"}
    assert bad(V.sampled_checks(ds, p.where("value <> 'bench'"), 1)) == {"sampled elements have their tags"}
    assert bad(V.sampled_checks(ds, p.withColumn("value", F.upper("value")), 1)) == {"sampled elements have their tags", "sampled elements have no other tags"}


def test_backrefs(spark, ds):
    def check(**parts):
        b, own = Backrefs(ds), Backrefs(ds)
        if "ways" in parts:
            b.node_ways = parts["ways"](own.node_ways)
        if "rels" in parts:
            b.parents = lambda e: parts["rels"](own.parents(e)) if e == "way" else own.parents(e)
        return bad(V.backref_checks(ds, b))

    extra = lambda df: df.unionByName(spark.createDataFrame([(10, 22)], df.schema))
    assert check() == set()
    for part, name in (("ways", ""), ("rels", "way members: ")):
        assert check(**{part: extra}) == {f"{name}pairs from references"}
        assert check(**{part: lambda df: df.limit(1)}) == {f"{name}references have pairs"}
        assert check(**{part: lambda df: df.unionByName(df.limit(1))}) == {f"{name}pairs distinct"}


def test_rings(spark, ds):
    xy = {10: (11.390, 47.260), 11: (11.401, 47.266), 12: (11.404, 47.269), 13: (11.409, 47.262)}
    schema = "rel_id bigint, polygon_no int, ring_no int, vertex_no int, node_id bigint, lon double, lat double"
    ring = lambda nodes, no=0, skip=0: [(30, 0, no, k + skip * (k > 1), n, *xy[n]) for k, n in enumerate(nodes)]
    check = lambda rows: bad(V.ring_checks(ds, spark.createDataFrame(rows, schema)))
    assert check(ring([11, 12, 13, 11])) == set() and check([]) == set()
    assert check(ring([11, 12, 13, 11], skip=1)) == {"vertices numbered"}
    assert check(ring([11, 12, 13, 10])) == {"rings closed"}
    assert check([(*r[:5], r[5] + 1e-4, r[6]) for r in ring([11, 12, 13, 11])]) == {"vertices at their nodes"}
    assert check(ring([11, 12, 13, 11], no=1)) == {"polygons begin with their outer ring"}
