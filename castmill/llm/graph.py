"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges a, b of any comparable type; returns node, root (smallest node reachable) for each node but the roots.

    Edges with a null end and loops link nothing; repeated edges count once; without edges there are no rows.
    Each step is written to the shared folder, and two numbers of it reach the driver."""
    spark = edges.sparkSession
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(now)
    while before[0]:
        with scratch(spark) as keep:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
            least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
            large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = keep(durable(small.union(low.select("a", F.col("m").alias("b"))).distinct()))
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
