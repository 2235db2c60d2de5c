import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cartolith.llm.topn import top_items, top_slots


def test_hot_group_spans_partitions(spark):
    rnd = random.Random(5)
    rows = [(1, rnd.randrange(50), i) for i in range(5000)] + [(g, rnd.randrange(3), i) for g in range(2, 300) for i in range(rnd.randrange(1, 6))] + [(None, 9, 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g bigint, score bigint, id bigint").repartition(7)
    for n in (1, 3, 1500, None):
        got = {(r["g"], r["top_no"]): r["id"] for r in top_items(df, "g", [F.desc("score"), F.asc("id")], n, ["id"]).collect()}
        want = {}
        for g in {r[0] for r in rows if r[0] is not None}:
            for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:n], 1):
                want[g, k] = r[2]
        assert got == want


def test_one_group_over_all_partitions(spark):
    df = spark.range(40_000).select(F.lit(7).cast("bigint").alias("g"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows would fit one task
    try:
        out = top_items(df, "g", [F.desc("id")], None, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.where("top_no <> 40000 - id").count() == 0 and out.count() == 40_000
    most = max(pq.read_metadata(f.removeprefix("file://")).num_rows for f in out.inputFiles())
    assert most < 40_000 * 0.6  # no task holds the group
    assert [tuple(r) for r in top_items(df, "g", [F.desc("id")], 2, ["id"]).orderBy("top_no").collect()] == [(7, 39_999, 1), (7, 39_998, 2)]


def test_slots(spark):
    rows = [("node", i, 1, s) for i, s in enumerate([5, 5, 6, 6, 7, 8])] + [("way", 1, 2, 9)]
    df = spark.createDataFrame(rows, "etype string, id bigint, key_idx bigint, slot bigint")
    slots = spark.createDataFrame([(5, 1, "k", "b"), (6, 1, "k", "B"), (7, 1, "k", None), (9, 2, "k", "")], "slot bigint, key_idx bigint, key string, value string")
    got = sorted((r["key_idx"], r["top_no"], r["slot"]) for r in top_slots(df, slots).collect())
    assert got == [(1, 1, 6), (1, 2, 5), (1, 3, 7), (2, 1, 9)]
    assert top_slots(df.limit(0), slots).count() == 0
