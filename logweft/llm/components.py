"""Connected components of a distributed graph by alternating star contractions. Nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """Edges of whole-number nodes -> (node, root): the smallest node of its component, for every node on an edge; and
    the path of the table that the frame reads, for drop(). Edges with a null end, loops and repeated edges say nothing
    new; without edges the result is empty.

    Large star: every node hands its larger neighbours to its smallest one; small star: its smaller ones. Both keep the
    components and shrink distances, so the rounds grow with the logarithm of the longest path. Every round is written
    to the shared folder. A node's edges meet in a partial minimum and a join by node, never in one list."""
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        df, path = cut(df, "star")
        paths.append(path)
        return df

    def state(df: DataFrame) -> tuple:
        """Tells sets of edges apart: a count, and two sums over their hashes."""
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38, 0)"))).first())

    # Each edge once, from the larger to the smaller node.
    now = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    before = state(now)
    while True:
        # Large star: the smallest of a node and its neighbours takes the larger neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = kept(both.join(low, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: a node's smallest neighbour takes the node and its other, smaller neighbours.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = kept(small)
        after = state(now)
        drop(spark, *paths[:-1])
        del paths[:-1]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()), paths[-1]
