"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import new_folder, removed, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) of every node of edges (a, b longs) but the roots.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs a round
    at most; the round before is deleted then. Only a count and a checksum come to the driver.
    """
    spark = edges.sparkSession
    path = new_folder(spark, "edges")
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, path = path, new_folder(spark, "edges")
        now = stored(moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), path)
        removed(spark, before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
