"""Connected components of a DataFrame of edges by alternating large and small stars.

Cases: edges with a null end, from a node to itself, and repeated ones are ignored; other columns too; without edges the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import kept


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a long, b long) that is not its root.

    Every step joins edges with one minimum for each node, so no node's neighbours are gathered; the number
    of steps grows with the logarithm of the largest component.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
