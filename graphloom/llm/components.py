"""Connected components of a table of links, by rounds of joins that each write to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, made, remove


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b), any order, a != b -> (node, root): root is the smallest node of the component.

    Large-star and small-star rounds (Kiveris et al., 2014) end after about log(n) rounds. Minima are aggregated before
    the shuffle; a node with very many links is split by Spark's skew join. No links: an empty table. Each round's table is
    removed when the next is written.
    """
    begun = len(made())
    edges = cut_lineage(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(spark, large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = cut_lineage(spark, small.where("a <> b").distinct(), "links")
        remove(*made(begun)[:-1])
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
