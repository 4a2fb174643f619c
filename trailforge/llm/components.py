"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node of its component.

    Each round replaces every link by one to the smallest neighbour; the number of rounds grows with the
    logarithm of the longest path. Rounds are written to the shared folder, nothing is collected but two sums.
    """
    spark = links.sparkSession
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(spark, e, "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.min("b").over(W.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = F.min("b").over(W.partitionBy("a"))
        near = large.withColumn("m", m)
        small = near.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = stored(spark, small, "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
