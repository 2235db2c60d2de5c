import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartolith.operators import orphans as O


def when(day):
    return datetime(2023, 1, 1) + timedelta(days=day) if day is not None else None


@pytest.fixture(scope="module")
def messy(make_dataset):
    rnd = random.Random(8)
    day = lambda: rnd.choice([None, *range(60)]) if rnd.random() < 0.05 else rnd.randrange(60)
    nodes = []
    for i in range(40):
        if rnd.random() < 0.8:
            for e in rnd.sample(range(60), rnd.randint(1, 3)):
                nodes.append((i, 1.0, 1.0, rnd.random() < 0.7, when(e), when(e + rnd.randrange(5))))
                if rnd.random() < 0.3:
                    nodes.append((*nodes[-1][:5], when(e + 9)))
    nodes.append((None, 1.0, 1.0, True, when(1), when(1)))
    refs = []
    for w in range(30):
        for p in range(rnd.randint(1, 4)):
            for e in rnd.sample(range(60), rnd.randint(1, 2)):
                refs.append((w, p, rnd.choice([None, *range(45)]), when(e), when(e + rnd.randrange(4))))
                if rnd.random() < 0.3:
                    refs.append((*refs[-1][:4], when(e + 11)))
    refs += [(None, 0, 1, when(1), when(1)), (99, 0, 500, None, None)]
    members = [(1, p, t, r, None, when(5), when(6)) for p, (t, r) in enumerate([(" NODE", 1), ("way", 2), ("Relation ", 3), ("thing", 1), (None, 1), ("node", None), ("node", 77)])]
    return make_dataset(nodes=nodes, way_refs=refs, members=members, ways=[(2, False, when(2), when(2))], relations=[(3, None, None, None, None, True, when(2), when(20))])


def brute(spark, root):
    read = lambda n: [r.asDict() for r in spark.read.parquet(f"{root}/{n}.parquet").collect()]
    far, never = datetime(9999, 1, 1), datetime(1, 1, 1)
    targets = {}
    for n in ("nodes", "ways", "relations"):
        for r in read(n):
            targets.setdefault((n, r["id"]), []).append(r)
    out = set()
    for tab, key, ref in (("way_refs", ("way_id", "pos"), "node_id"), ("members", ("rel_id", "pos"), "ref_id"), ("ring_vertices", ("rel_id", "ring_no", "vertex_no"), "node_idx")):
        cur = {}
        for r in read(tab):
            k = tuple(r[c] for c in key)
            rank = (r["edited_at"] or never, -(r["loaded_at"] or far).timestamp())
            if None not in k and (k not in cur or rank > cur[k][0]):
                cur[k] = (rank, r)
        for k, (_, r) in cur.items():
            t = "nodes" if tab != "members" else {"node": "nodes", "way": "ways", "relation": "relations"}.get((r["mtype"] or "").strip().lower())
            if r[ref] is None or t is None:
                continue
            rows = targets.get((t, r[ref]), [])
            last = max(rows, key=lambda x: x["edited_at"] or never, default=None)
            first = min((x["loaded_at"] for x in rows if x["loaded_at"]), default=None)
            why = "missing" if not rows else "deleted" if not last["visible"] else "late" if first and r["loaded_at"] and first > r["loaded_at"] else None
            if why:
                out.add((tab, k[0], k[1] if tab == "ring_vertices" else 0, k[-1], r["edited_at"].strftime("%Y-%m") if r["edited_at"] else None, why))
    return sorted(out, key=repr)


@pytest.mark.parametrize("epochs", [1, 3])
def test_batches_do_not_matter(spark, messy, epochs):
    got = sorted(map(tuple, O.orphans(spark, messy, epochs).collect()), key=repr)
    assert got == brute(spark, messy)


def test_repeated_and_empty_batches(spark, messy):
    t, r = O.all_versions(spark, messy)
    s = O.OrphanState.start(t, r)
    again = s.apply(t, r)
    empty = again.apply(t.limit(0), r.limit(0))
    a, b, c = (sorted(map(tuple, O.named(x.pending).collect()), key=repr) for x in (s, again, empty))
    assert a == b == c
    assert sum(x["n"] for x in s.snapshot().collect()) == len(a)


def size(df):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())


def test_a_batch_writes_in_proportion(spark):
    t = spark.range(200_000).select(F.lit(0).cast("tinyint").alias("kind"), "id", F.lit(5).cast("bigint").alias("edited"), (F.col("id") % 7 != 0).alias("visible"), F.lit(6).cast("bigint").alias("arrived"))
    r = spark.range(400_000).select(F.lit(0).cast("tinyint").alias("tab"), F.col("id").alias("owner_id"), F.lit(0).cast("bigint").alias("ring_no"), F.lit(0).cast("bigint").alias("pos"),
                                   F.lit(0).cast("tinyint").alias("kind"), (F.col("id") * 7919 % 250_000).alias("ref"), F.lit(9).cast("bigint").alias("edited"), F.lit(10).cast("bigint").alias("loaded"))
    s = O.OrphanState.start(t, r)
    some = t.where("id % 100 = 3").withColumn("edited", F.lit(50).cast("bigint")).withColumn("visible", F.col("id") % 200 == 3)
    late = some.unionByName(spark.range(249_000, 249_400).select(F.lit(0).cast("tinyint").alias("kind"), "id", F.lit(1).cast("bigint").alias("edited"), F.lit(True).alias("visible"), F.lit(70).cast("bigint").alias("arrived")))
    new = r.where("owner_id % 100 = 50").withColumn("edited", F.lit(60).cast("bigint")).withColumn("ref", F.lit(1).cast("bigint"))
    after = s.apply(late, new)
    for part in ("targets", "refs"):
        base, delta = getattr(after, part)
        assert size(delta) < size(base) / 25, part
    touched = r.join(late.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").count() + new.count()
    assert after.found[1].count() <= touched < 10_000
    whole = O.OrphanState.start(t.unionByName(late), r.unionByName(new))
    same = lambda a, b: a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert same(after.pending, whole.pending) and same(after.merged().pending, whole.pending) and after.pending.count() > 1000


def test_deltas_are_merged(spark, messy, monkeypatch):
    monkeypatch.setattr(O, "MOST_DELTAS", 2)
    t, r = O.all_versions(spark, messy)
    nth = lambda df, c, k: df.where(f"pmod(hash({c}, edited), 6) = {k}")
    s = O.OrphanState.start(nth(t, "id", 0), nth(r, "owner_id", 0))
    for k in range(1, 6):
        s = s.apply(nth(t, "id", k), nth(r, "owner_id", k))
        assert len(s.targets) <= 2
    assert sorted(map(tuple, O.named(s.pending).collect()), key=repr) == brute(spark, messy)


def test_empty(spark, make_dataset):
    assert O.orphans(spark, make_dataset()).count() == 0
