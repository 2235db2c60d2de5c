import random
from collections import Counter, defaultdict

from cartolith.operators import skew


def test_totals_under_skew(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE_ROWS", 300)
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(500)) for _ in range(3000)] + [(2, 7)] * 2500 + [(rnd.randrange(10, 400), rnd.randrange(5)) for _ in range(1500)]
    rows += [(None, 1), (3, None), (3, 4)]
    df = spark.createDataFrame(rows, "key_idx bigint, slot bigint").withColumn("extra", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    n, items = Counter(k for k, _ in rows if k is not None), defaultdict(set)
    for k, s in rows:
        if s is not None:
            items[k].add(s)
    got = {r["key_idx"]: (r["n_rows"], r["n_items"]) for r in skew.key_totals(df).collect()}
    assert got == {k: (n[k], len(items[k])) for k in n}
    dom = sorted(map(tuple, skew.dominant_keys(df).collect()))
    total, slots = sum(n.values()), sum(len(v) for v in items.values() if v) - len(items.get(None, ()))
    want = [("rows", k) for k in n if n[k] * 20 >= total] + [("slots", k) for k in n if len(items[k]) * 20 >= slots]
    assert dom == sorted(want)


def test_empty(spark):
    e = spark.createDataFrame([], "key_idx bigint, slot bigint")
    assert skew.key_totals(e).count() == 0
    assert skew.dominant_keys(e).count() == 0
