"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import new_folder, removed, stored


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each node of edges (a, b longs) but the roots themselves.

    Large and small stars in turn: a node's larger neighbours go to its smallest, then a node's smaller ones do. Each
    round is written and the one before deleted; the driver gets a count and a checksum.
    """
    spark = edges.sparkSession
    path = new_folder(spark, "stars")
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    marked = lambda edges: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = marked(now)  # stars already need one round only
    while mark[0]:
        ways = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(hub, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hub = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hub, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, path = path, new_folder(spark, "stars")
        now = stored(small.union(hub.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), path)
        removed(spark, old)
        before, mark = mark, marked(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
