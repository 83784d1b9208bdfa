"""Edge tables: nearest neighbours, contraction, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.operators.spatial import both_ways, unsent


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new local one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridfuse-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, to cut the lineage of loops; `discard` deletes it."""
    spark: SparkSession = df.sparkSession
    path = os.path.join(folder(spark), f"loop-{uuid.uuid4().hex}")
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_path = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by `saved` that nothing will read again; others are left alone."""
    for table in tables:
        path = getattr(table, "saved_path", None)
        if path:
            spark = table.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def nearest_edge(edges: DataFrame, hashed: bool = False) -> DataFrame:
    """(src, dst, d): each node's nearest neighbour by d; ties go to the smaller id, or with `hashed` to the pair of the smaller hash.

    Where many prices are equal, the smaller id makes long chains of which one pair is mutual; hashes are the same seen from both ends and break them up.
    """
    if hashed:
        from gridfuse.operators import forest  # imports this module

        rows = both_ways(edges.select("src", "dst", "d").withColumn("h", forest.pair_hash(F.least("src", "dst"), F.greatest("src", "dst"))))
        best = rows.groupBy("src").agg(F.min(F.struct("d", "h", F.least("src", "dst"), F.greatest("src", "dst"), "dst")).alias("m"))
        return best.select("src", F.col("m.dst").alias("dst"), F.col("m.d").alias("d"))
    best = both_ways(edges.select("src", "dst", "d")).groupBy("src").agg(F.min(F.struct("d", "dst")).alias("m"))
    return best.select("src", F.col("m.dst").alias("dst"), F.col("m.d").alias("d"))


def mutual(nearest: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of nodes that are nearest to each other."""
    back = nearest.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return nearest.join(back, ["src", "dst"], "left_semi").filter("src < dst").select("src", "dst")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct edges between labels, without loops."""
    a = labels.select(F.col("vid").alias("src"), F.col("cid").alias("a"))
    rows = edges.join(unsent(a), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("a").alias("b"))), "dst").filter("a <> b")
    return rows.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, cid): the smallest node reachable. Minimum labels spread along edges, then labels of labels are taken over."""
    both = saved(both_ways(edges.select("src", "dst")).distinct())
    labels = nodes.select("vid", F.col("vid").alias("cid"))
    while True:
        near = both.join(unsent(labels.withColumnRenamed("vid", "dst")), "dst").groupBy("src").agg(F.min("cid").alias("m"))
        spread = labels.join(unsent(near.withColumnRenamed("src", "vid")), "vid", "left").select("vid", F.col("cid").alias("old"), F.least("cid", "m").alias("cid"))
        jump = spread.select(F.col("vid").alias("cid"), F.col("cid").alias("up"))
        new = saved(spread.join(unsent(jump), "cid").select("vid", F.col("up").alias("cid"), (F.col("up") != F.col("old")).alias("moved")))
        discard(labels)
        labels = new.select("vid", "cid")
        labels.saved_path = new.saved_path
        if new.filter("moved").isEmpty():
            discard(both)
            return labels


def pointed(nearest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vid, cid): components of a graph in which each node points to its nearest, named by the smaller node of their closest pair.

    Ties go to the smaller id, so the only cycles are mutual pairs. Pointers double along, four times a table, so
    the passes are a quarter of the logarithm of the longest chain. A node without a nearest one stays alone.
    """
    at = nodes.select("vid").join(nearest.select(F.col("src").alias("vid"), "dst"), "vid", "left").select("vid", F.coalesce("dst", "vid").alias("to"))
    back = at.select(F.col("vid").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("vid")) & (F.col("vid") < F.col("to"))
    at = at.join(back, "to").select("vid", F.when(root, F.col("vid")).otherwise(F.col("to")).alias("to"))
    while True:
        at = saved(at)
        once = at.select("vid", "to")
        for _ in range(4):
            once = once.join(once.select(F.col("vid").alias("to"), F.col("to").alias("next")), "to").select("vid", F.col("next").alias("to"))
        last = once.select(F.col("vid").alias("to"), F.col("to").alias("next"))
        new = saved(once.join(last, "to").select("vid", "to", (F.col("next") != F.col("to")).alias("moved")))
        discard(at)
        if new.filter("moved").isEmpty():
            found = new.select("vid", F.col("to").alias("cid"))
            found.saved_path = new.saved_path
            return found
        at = new.select("vid", "to")


def penalised(edges: DataFrame, image: DataFrame, weight: float) -> DataFrame:
    """(src, dst, d): prices times 1 + weight * |difference of the image (vid, g)|."""
    a = image.select(F.col("vid").alias("src"), F.col("g").alias("a"))
    rows = edges.join(a, "src").join(a.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    return rows.select("src", "dst", (F.col("d") * (1 + weight * F.abs(F.col("a") - F.col("b")))).alias("d"))


def fragments(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, cid): each connected part of a label becomes a label of its own, named by its smallest voxel."""
    a = labels.select(F.col("vid").alias("src"), F.col("cid").alias("a"))
    same = edges.select("src", "dst").join(unsent(a), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("a").alias("b"))), "dst").filter("a = b")
    return components(labels.select("vid"), same.select("src", "dst"))
