"""Connected groups of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rounds, saved


def components(links: DataFrame, n: int) -> DataFrame:
    """node, part: the least node that links (u, v; about n of them, in either direction) connect each node with.

    The least label spreads along links and is then replaced by the label of the
    node it names, which halves what is left with each round. Nodes with links
    only; a node linked to itself is a part.
    """
    spark = links.sparkSession
    with rounds(spark, n):
        both, _ = saved(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
        part, _ = saved(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("part")), "part")
        while True:
            sent = both.join(part.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("part").alias("got"))
            step = part.join(sent, "node").select("node", F.least("part", "got").alias("near"), F.col("part").alias("old"))
            # and on to the label of the node that the label names
            far = part.select(F.col("node").alias("near"), F.col("part").alias("far"))
            new = step.join(far, "near").select("node", F.least("near", "far").alias("part"), (F.least("near", "far") < F.col("old")).alias("moved"))
            part, seen = saved(new, "part", moved=F.count_if("moved"))
            part = part.select("node", "part")
            if not seen["moved"]:
                return part
