"""Labels arriving voxels by fitted centers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfuse.operators import spatial


def label_stream(voxels: DataFrame, centers: DataFrame, step: float, weight: float, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes (vid, cid) of each batch below `path`; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        spatial.assign(batch, centers, step, weight).write.mode("overwrite").parquet(f"{path}/batch={number}")

    made = voxels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()


def _sums(rows: DataFrame, *parts: Column) -> DataFrame:
    """(cid, pos, v): sums of the parts' entries, one after another; position 0 counts, 1 to 3 are the place, the rest features."""
    return rows.select("cid", F.posexplode(F.concat(*parts)).alias("pos", "v")).groupBy("cid", "pos").agg(F.sum("v").alias("v"))


def start_sums(centers: DataFrame) -> DataFrame:
    """Sums (cid, pos, v) of centers (cid, n, feat, cx, cy, cz)."""
    n = F.col("n").cast("double")
    return _sums(centers, F.array(n, F.col("cx") * n, F.col("cy") * n, F.col("cz") * n), F.transform("feat", lambda f: f * n))


def means(sums: DataFrame) -> DataFrame:
    """Centers (cid, n, feat, cx, cy, cz) of sums (cid, pos, v)."""
    v = F.col("v")
    rows = sums.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s.v).alias("v"))
    return rows.select("cid", v[0].cast("long").alias("n"), F.transform(F.slice("v", 5, F.size("v") - 4), lambda f: f / v[0]).alias("feat"), *[(v[i] / v[0]).alias(f"c{c}") for i, c in enumerate("xyz", 1)])


def add_batch(batch: DataFrame, number: int, start: DataFrame, step: float, weight: float, path: str) -> None:
    """Labels a batch by the means before it and writes the sums after it as version `number`.

    A batch reads the version before its own only and overwrites its own, so one that is run again counts once. An empty batch hands its sums on.
    """
    spark = batch.sparkSession
    before = spark.read.parquet(f"{path}/sums/version={number - 1}") if number else start_sums(start)
    labels = f"{path}/labels/batch={number}"
    spatial.assign(batch, means(before), step, weight).select(F.col("vid").cast("long"), F.col("cid").cast("long")).write.mode("overwrite").parquet(labels)
    rows = batch.join(spark.read.schema("vid long, cid long").parquet(labels), "vid")
    place = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in "xyz"])
    added = before.select("cid", "pos", "v").union(_sums(rows, place, F.col("ts")))
    added.groupBy("cid", "pos").agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{path}/sums/version={number}")


def running_centers(voxels: DataFrame, centers: DataFrame, step: float, weight: float, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Labels each batch of voxels by the running means of `centers` (with their n) and all batches before it.

    Writes labels (vid, cid) below `path`/labels and versions of the sums (cid, pos, v) below `path`/sums; `means` makes centers of a version.
    """
    made = voxels.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, centers, step, weight, path)).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()
