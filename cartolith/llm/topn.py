"""The first N items of every group in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .runs import first_of_runs


def _fields(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def top_items(rows: DataFrame, group: str, order: list[Column], n: int | None, keep: list[str]) -> DataFrame:
    """keep and top_no (from 1) of the first n rows of each group, by a global sort.

    Rows are range-partitioned and sorted by group and order; a group of any
    size is spread over neighbouring partitions. Each partition numbers its rows
    within their group, drops what is beyond n already, and is written. Counts
    by group and partition are then prefix-summed and added to the numbers. Only
    the group that a partition begins with can have rows before it, so there are
    no more sums than partitions, and they are broadcast. group is a BIGINT; rows
    with a null group are left out. order must tell all rows of a group apart for
    a fixed result; ties beyond it are broken arbitrarily. n None numbers all rows.
    """
    ship(rows.sparkSession)
    by = [F.col(group), *order]
    keep = [group, *(k for k in keep if k != group)]
    s = rows.where(F.col(group).isNotNull()).repartitionByRange(*by).sortWithinPartitions(*by)
    kept = materialize(s.mapInArrow(first_of_runs(group, n, keep), _fields(rows, keep) + ", part bigint, local bigint"), "top")
    firsts = kept.groupBy("part").agg(F.min(group).alias(group)).select(group).distinct()
    counts = kept.join(F.broadcast(firsts), group, "left_semi").groupBy(group, "part").agg(F.max("local").alias("n"))
    w = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "part", F.sum("n").over(w).alias("before")).where("before is not null")
    placed = kept.join(F.broadcast(before), [group, "part"], "left").withColumn("top_no", F.col("local") + F.coalesce("before", F.lit(0)))
    if n is not None:
        placed = placed.where(F.col("top_no") <= n)
    return placed.select(*keep, "top_no")


def top_slots(tag_rows: DataFrame, tag_slots: DataFrame, n: int = 3) -> DataFrame:
    """key_idx, top_no, slot: of each key the n slots with the most elements, then smallest value.

    A slot without an entry in tag_slots or with a null value comes after equal
    ones with a value; last, the smaller slot is first. No tag rows give no rows.
    """
    tally = tag_rows.groupBy("key_idx", "slot").agg(F.count(F.lit(1)).alias("n"))
    value = tag_slots.groupBy("slot").agg(F.min("value").alias("value"))
    t = tally.join(value, "slot", "left")
    return top_items(t, "key_idx", [F.desc("n"), F.asc_nulls_last("value"), F.asc("slot")], n, ["slot"])
