"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b``; the label is the smallest node that it is connected with.

    Alternates two star contractions until nothing changes, a number of rounds that
    grows with the logarithm of the longest path. Each round is written to the
    shared folder. Only a sum over all edges, to see the end, reaches the driver.
    """
    links = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    while True:
        # Large star: a node's larger neighbours move to its smallest one.
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).where("u <> v").distinct()
        links = stored(moved, "edges")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("_v")), "node", "left").select(
        "node", F.coalesce("_v", "node").alias("label"))
