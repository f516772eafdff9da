"""Connected components of a distributed edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges(a long, b long)``.

    Each round links the larger neighbours of a node, then the smaller ones, to the smallest
    neighbour; it ends when a round changes nothing. Minima are summed map-side, so a hub is not
    gathered in one task. Edges with a null end and loops count for nothing; no edges, no nodes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first()
        if mark[0] == 0 or mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = written(small.filter("a <> b").distinct(), "edges")
