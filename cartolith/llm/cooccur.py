"""How often two items occur in one record, and how much more often than by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, materialize, ship
from .runs import run_lengths

#: Items of a record up to which its pairs are made in one row; a larger record is split into pairs of blocks.
BLOCK = 512
_HALF = 1 << 31


def _pairs_of(arrays: DataFrame) -> DataFrame:
    """kind, code of all pairs within arrays (kind, items), sorted and distinct."""
    a = arrays.select("kind", "items", F.posexplode("items").alias("i", "a"))
    a = a.where(F.col("i") + 1 < F.size("items"))
    b = a.select("kind", "a", F.explode(F.slice(F.col("items"), F.col("i") + 2, F.size("items"))).alias("b"))
    return b.select("kind", F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("code"))


def _pairs_of_large(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """kind, code of all pairs of large records, from rows (rec, kind, item) and sizes (rec, n).

    Items are dealt to blocks by hash; each pair of blocks is a group of its own,
    so no group holds more than about two blocks and the work is spread.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    r = rows.join(F.broadcast(sizes) if bounded(sizes, 64) else sizes, "rec").withColumn("nb", blocks)
    r = r.withColumn("own", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    g = r.groupBy("rec", "kind", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(
        F.collect_set(F.when(F.col("own") == F.least("own", "other"), F.col("item"))).alias("xs"),
        F.collect_set(F.when(F.col("own") == F.greatest("own", "other"), F.col("item"))).alias("ys"))
    x = g.select("kind", "p", "q", "ys", F.explode("xs").alias("x"))
    xy = x.select("kind", "p", "q", "x", F.explode("ys").alias("y")).where("p <> q or x < y")
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    return xy.select("kind", F.shiftleft(lo, 32).bitwiseOR(hi).alias("code"))


def count_runs(codes: DataFrame) -> DataFrame:
    """kind, code, n by external sort and run lengths.

    Codes are sorted where they arise and equal ones merged, so that a pair sent
    by many records moves as one row per task; then runs are merged by hash of
    the code, sorted and counted again.
    """
    ship(codes.sparkSession)
    schema, keys = "kind bigint, code bigint, n bigint", ["kind", "code"]
    s = codes.select(F.col("kind").cast("bigint").alias("kind"), "code", F.lit(1).cast("bigint").alias("n"))
    s = s.sortWithinPartitions(*keys).mapInArrow(run_lengths(keys, "n"), schema)
    return s.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run_lengths(keys, "n"), schema)


def _codes(rows: DataFrame, items: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """rows with items below 2**31; the dictionary (kind, item, code), or None where items are their own codes."""
    ends = rows.agg(*(f(c) for c in items for f in (F.min, F.max))).first()
    if all(v is None or 0 <= v < _HALF for v in ends):
        return rows, None
    from .topn import top_items

    both = F.array(*(F.struct(F.lit(k).cast("bigint").alias("kind"), F.col(c).alias("item")) for k, c in enumerate(items)))
    ids = top_items(rows.select(F.inline(both)).dropna().distinct(), "kind", [F.asc("item")], None, ["item"])
    ids = materialize(ids.select("kind", "item", F.col("top_no").alias("code")), "codes")
    if ids.where(F.col("code") >= _HALF).limit(1).count():
        raise ValueError("more than 2**31 different items of one kind")
    for k, c in enumerate(items):
        rows = rows.join(ids.where(F.col("kind") == k).select(F.col("item").alias(c), "code"), c, "left").drop(c).withColumnRenamed("code", c)
    return materialize(rows, "coded"), ids


def item_pairs(rows: DataFrame, rec: list[str], items: list[str], min_together: int = 1, min_times: int = 0) -> DataFrame:
    """kind, id_a < id_b, together_count, n_a, n_b, n of pairs of items of one kind in one record.

    rec: columns that name a record; items: BIGINT columns, one for each kind of
    item; kind is the number of the column. Repeated items of a record count
    once; null items are left out, rows with a null part of rec as well; n is the
    number of distinct records with an item. Pairs are kept with together_count
    >= min_together and together_count * n >= min_times * n_a * n_b, tested in
    exact arithmetic. Items outside 0..2**31-1 get dense codes first.
    """
    spark = rows.sparkSession
    rows = rows.select(*rec, *items).dropna(subset=rec).where(F.coalesce(*items).isNotNull())
    rows, ids = _codes(rows, items)
    sizes = rows.groupBy(*rec).agg(F.count(F.lit(1)).alias("n"))
    n, large = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("n") > BLOCK)).first()
    small = rows
    if large:
        big = materialize(sizes.where(F.col("n") > BLOCK).select(F.struct(*rec).alias("rec"), "n"), "large")
        held = F.broadcast(big) if bounded(big, 64) else big
        named = rows.withColumn("rec", F.struct(*rec))
        small = named.join(held, "rec", "left_anti")
    sets = small.groupBy(*rec).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in items)).select(*items)
    sets = materialize(sets, "sets")
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("items")) for k, c in enumerate(items)))
    arrays = sets.select(F.inline(each)).where(F.size("items") > 0)
    codes, single = _pairs_of(arrays), arrays.select("kind", F.explode("items").alias("item"))
    if large:
        one = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in enumerate(items)))
        lrows = named.join(held, "rec", "left_semi").select("rec", F.inline(one)).dropna()
        codes = codes.unionByName(_pairs_of_large(lrows, big))
        single = single.unionByName(lrows.distinct().select("kind", "item"))
    counts = single.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together)
    pairs = count_runs(codes).where(F.col("n") >= min_together)
    mask = F.lit((1 << 32) - 1)
    pairs = pairs.select(F.col("kind").cast("int").alias("kind"), F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND(mask).alias("id_b"), F.col("n").alias("together_count"))
    pairs = pairs.join(counts.select("kind", F.col("item").alias("id_a"), F.col("n").alias("n_a")), ["kind", "id_a"])
    pairs = pairs.join(counts.select("kind", F.col("item").alias("id_b"), F.col("n").alias("n_b")), ["kind", "id_b"])
    pairs = pairs.withColumn("n", F.lit(n).cast("bigint"))
    if min_times:
        exact = lambda c, p: F.col(c).cast(f"decimal({p},0)")
        pairs = pairs.where(exact("together_count", 18) * exact("n", 18) >= exact("n_a", 17) * exact("n_b", 17) * F.lit(min_times))
    if ids is not None:
        ids = ids.withColumn("kind", F.col("kind").cast("int"))
        for c in ("id_a", "id_b"):
            pairs = pairs.join(ids.select("kind", F.col("code").alias(c), F.col("item").alias(f"{c}_item")), ["kind", c]).drop(c).withColumnRenamed(f"{c}_item", c)
    return pairs.select("kind", "id_a", "id_b", "together_count", "n_a", "n_b", "n")


def with_odds(pairs: DataFrame) -> DataFrame:
    """Adds times (how many times more than by chance) and odds_ratio, with 0.5 added to each cell of the table."""
    c, a, b, n = (F.col(x).cast("double") for x in ("together_count", "n_a", "n_b", "n"))
    odds = ((c + 0.5) * (n - a - b + c + 0.5)) / ((a - c + 0.5) * (b - c + 0.5))
    return pairs.withColumn("times", (c * n) / (a * b)).withColumn("odds_ratio", odds)
