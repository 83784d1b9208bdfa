"""Connected components of a table of links, by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm import common


def connected(links: DataFrame) -> DataFrame:
    """links(a, b), any order and repeats allowed -> (node, component), component being the smallest node reachable.

    Each pass is a grouped minimum and a join on its key, so a hub costs partial
    aggregation and a join that Spark splits; the links stay in tables in the
    shared folder and only their number and a checksum reach the driver. Links
    with a null end or equal ends are of no effect.
    """
    spark = links.sparkSession
    edges, path = common.cut(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        # Large star: every larger neighbour of u moves to u's smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of these.
        large, large_path = common.cut(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = common.cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        common.drop(spark, path)
        common.drop(spark, large_path)
        edges, path = nxt, nxt_path
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
