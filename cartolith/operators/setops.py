"""Set operations over id columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, saved


def intersect(sets: list[DataFrame]) -> DataFrame:
    """Distinct ids in every one of sets; an empty list has none and is refused."""
    if not sets:
        raise ValueError("no sets to intersect")
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), [sets[0].select("id").distinct(), *(s.select("id") for s in sets[1:])])


def union(sets: list[DataFrame]) -> DataFrame:
    """Distinct ids in any of sets."""
    return reduce(DataFrame.unionByName, [s.select("id") for s in sets]).distinct()


def _stretch(c: Column, width: int) -> Column:
    """Number of the stretch of `width` ids that holds c, exact for all 64 bits."""
    return F.call_function("div", c - F.pmod(c, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))


def id_ranges(ids: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Maximal runs of consecutive ids as start (inclusive) and stop (exclusive).

    Runs are found within stretches of `width` ids, so that no task sees all of
    them. Whole stretches that follow each other are runs of stretch numbers and
    found in the same way (a level for every log2(width) bits of an id); runs
    that touch one border of a stretch are joined to what touches it from the
    other side by the border's number. Null ids are left out.
    """
    s = ids.select("id").dropna().distinct().withColumn("part", _stretch(F.col("id"), width))
    w = Window.partitionBy("part").orderBy("id")
    runs = s.withColumn("grp", F.col("id") - F.row_number().over(w)).groupBy("part", "grp").agg(F.min("id").alias("start"), (F.max("id") + 1).alias("stop"))
    low, high = F.col("start") % width == 0, F.col("stop") % width == 0
    runs, n = saved(runs.select("start", "stop", low.alias("low"), high.alias("high")), "runs", whole=F.count_if(low & high), touch=F.count_if(low | high))
    inner = runs.where("not low and not high").select("start", "stop")
    if not n["touch"]:
        return inner
    up, down = runs.where("high and not low").select("start", F.col("stop").alias("at")), runs.where("low and not high").select(F.col("start").alias("at"), "stop")
    if n["whole"]:
        chains = id_ranges(runs.where("low and high").select(_stretch(F.col("start"), width).alias("id")), width)
        chains = materialize(chains.select((F.col("start") * width).alias("a"), (F.col("stop") * width).alias("b")), "chains")
        left = up.select(F.col("start").alias("from"), F.col("at").alias("a"))
        right = down.select(F.col("at").alias("b"), F.col("stop").alias("to"))
        whole = chains.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("from", "a").alias("start"), F.coalesce("to", "b").alias("stop"))
        inner = inner.unionByName(whole)
        up, down = up.join(chains.select(F.col("a").alias("at")), "at", "left_anti"), down.join(chains.select(F.col("b").alias("at")), "at", "left_anti")
    met = up.join(down, "at", "full").select(F.coalesce("start", "at").alias("start"), F.coalesce("stop", "at").alias("stop"))
    return inner.unionByName(met)


def within_ranges(ids: DataFrame, ranges: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Ids inside any of ranges (start, stop), joined on stretches of `width` ids."""
    r = ranges.withColumn("part", F.explode(F.sequence(_stretch(F.col("start"), width), _stretch(F.col("stop") - 1, width))))
    i = ids.withColumn("part", _stretch(F.col("id"), width))
    on = (F.col("i.part") == F.col("r.part")) & (F.col("i.id") >= F.col("r.start")) & (F.col("i.id") < F.col("r.stop"))
    return i.alias("i").join(r.alias("r"), on, "left_semi").drop("part")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with each row's place from 0 in the order of by, from counts of sorted partitions; by must tell all rows apart."""
    d = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    d = d.withColumn("_part", F.shiftright("_at", 33))
    counts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as partitions
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.join(F.broadcast(before), "_part").select(*df.columns, (F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
