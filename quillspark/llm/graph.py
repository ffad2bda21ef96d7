"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

MAX_ROUNDS = 60


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """edges(a, b) to (node, root): root is the smallest node it reaches.

    Each round is two aggregations (with map-side partial minima) and two joins
    on the node; a node of large degree is split by the skew-join rule. Every
    round is a table in the shared folder, and the former one is dropped. Rounds
    grow with the logarithm of the longest chain.
    """
    e = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        small = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = shelf.put(small)
        shelf.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))"), F.expr("bit_xor(xxhash64(b, a))")).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not converge")
