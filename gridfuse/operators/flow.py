"""Sparse column-stochastic matrices (row, col, x) and the steps of Markov clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.operators import graph


def normalised(m: DataFrame) -> DataFrame:
    """Each column over its sum."""
    sums = m.groupBy("col").agg(F.sum("x").alias("s"))
    return m.join(sums, "col").select("row", "col", (F.col("x") / F.col("s")).alias("x"))


def with_loops(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """The matrix with a loop of 1 for each node (vid) whose column is empty."""
    lone = nodes.select(F.col("vid").alias("col")).join(m.select("col").distinct(), "col", "left_anti")
    return m.select("row", "col", "x").union(lone.select(F.col("col").alias("row"), "col", F.lit(1.0).alias("x")))


def pruned(m: DataFrame, most: int, least: float) -> DataFrame:
    """The `most` largest entries over `least` of each column; ties go to the smaller row."""
    w = Window.partitionBy("col").orderBy(F.desc("x"), "row")
    return m.filter(F.col("x") > least).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).select("row", "col", "x")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product; after `pruned` a column has a bounded number of entries, and so has the join."""
    rows = a.select("row", F.col("col").alias("k"), F.col("x").alias("p")).join(b.select(F.col("row").alias("k"), "col", F.col("x").alias("q")), "k")
    return rows.groupBy("row", "col").agg(F.sum(F.col("p") * F.col("q")).alias("x"))


def inflated(m: DataFrame, power: float) -> DataFrame:
    return normalised(m.select("row", "col", F.pow("x", F.lit(power)).alias("x")))


def from_edges(nodes: DataFrame, edges: DataFrame, loop: float = 1.0) -> DataFrame:
    """Both directions of (src, dst, w) and a loop for each node, column-stochastic."""
    both = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("x"))
    both = both.union(both.select("col", "row", "x")).union(nodes.select("vid", "vid", F.lit(loop).alias("x")))
    return normalised(both.filter("x > 0"))


def attractors(m: DataFrame) -> DataFrame:
    """(vid, cid): the row of each column's greatest entry; ties go to the smaller row."""
    return m.groupBy("col").agg(F.min(F.struct((-F.col("x")).alias("x"), F.col("row"))).alias("m")).select(F.col("col").alias("vid"), F.col("m.row").alias("cid"))


def markov(nodes: DataFrame, edges: DataFrame, inflation: float = 1.6, most: int = 32, least: float = 1e-6, rounds: int = 8, tol: float = 1e-4) -> DataFrame:
    """(vid, cid) of Markov clustering: expansion, inflation and pruning until no entry changes by `tol`."""
    if inflation <= 1:
        raise ValueError("inflation must be over 1")
    m = graph.saved(from_edges(nodes, edges))
    for _ in range(rounds):
        new = graph.saved(normalised(with_loops(pruned(inflated(product(m, m).filter(F.col("x") > least), inflation), most, least), nodes)))
        change = new.join(m.withColumnRenamed("x", "y"), ["row", "col"], "full").agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).first()[0]
        m = new
        if (change or 0.0) < tol:
            break
    return attractors(m)
