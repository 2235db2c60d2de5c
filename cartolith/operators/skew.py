"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this share of the rows or more is heavy; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.005
#: Rows the detecting sample is to have on average. It only routes keys; results are exact either way.
SAMPLE_ROWS = 200_000
#: Parts over which a heavy key's items are spread.
PARTS = 64


def heavy_keys(rows: DataFrame, key: str, total: int, share: float = HEAVY_SHARE) -> list:
    """Keys that hold about `share` of the rows or more, by a seeded sample.

    The list is bounded by 2 / share whatever the data.
    """
    sample = rows.select(key).dropna()
    if total > SAMPLE_ROWS:
        sample = sample.sample(fraction=SAMPLE_ROWS / total, seed=7)
    least = max(1, int(min(total, SAMPLE_ROWS) * share))
    top = sample.groupBy(key).count().where(F.col("count") >= least)
    return [r[0] for r in top.orderBy(F.desc("count"), key).limit(int(2 / share)).collect()]


def key_totals(rows: DataFrame, key: str = "key_idx", item: str = "slot") -> DataFrame:
    """key, n_rows, n_items (distinct items) of every key, exact under any skew.

    Heavy keys, found by a sample, are routed by a broadcast list: their rows
    are spread over PARTS by item, counted there, and the parts' counts added
    (an item is in one part only, so distinct counts add up). All other keys go
    through one ordinary shuffle by key. Null keys are left out, null items
    count as rows only; an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("k"), F.col(item).alias("i")).where(F.col("k").isNotNull())
    total = rows.count()
    heavy = heavy_keys(rows, "k", total)
    kind = rows.schema["k"].dataType.simpleString()
    listed = F.broadcast(spark.createDataFrame([(h,) for h in heavy], f"k {kind}"))
    # equal items are counted before any shuffle, so an item that fills a key moves as one row per task
    part = F.pmod(F.xxhash64("i"), F.lit(PARTS)).alias("part")
    hot = rows.join(listed, "k", "left_semi").select("k", part, "i")
    hot = hot.groupBy("k", "part", "i").agg(F.count(F.lit(1)).alias("n"))
    hot = hot.groupBy("k", "part").agg(F.sum("n").alias("n_rows"), F.count("i").alias("n_items"))
    hot = hot.groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_items").alias("n_items"))
    cold = rows.join(listed, "k", "left_anti").groupBy("k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("i").alias("n_items"))
    return hot.unionByName(cold).select(F.col("k").alias(key), "n_rows", "n_items")


def dominant_keys(rows: DataFrame, per_hundred: int = 5, key: str = "key_idx", item: str = "slot") -> DataFrame:
    """what ('rows' or 'slots') and key of each key with at least that share of the rows or of the distinct items."""
    from ..session import materialize

    t = materialize(key_totals(rows, key, item), "key-totals")  # one row a key; read for the sums and for the shares
    # an item belongs to one key or counts once under each, so the sum over keys is the number in use
    all_rows, all_items = t.agg(F.sum("n_rows"), F.sum("n_items")).first()
    big = lambda n, of: F.col(n) * 100 >= F.lit((of or 0) * per_hundred)
    what = F.array(F.when(big("n_rows", all_rows), "rows"), F.when(big("n_items", all_items), "slots"))
    return t.select(F.explode(F.array_compact(what)).alias("what"), key)
