"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``, the smallest node reachable.

    Alternates large-star and small-star steps until no link changes.  Both
    aggregate before they shuffle, and their joins let Spark split a hot node.
    Self-links, nulls and repeated links have no effect; nodes without a link
    to another node are not returned.
    """
    e = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
