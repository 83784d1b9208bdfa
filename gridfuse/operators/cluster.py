"""Clustering methods that are loops over the relational operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, groups, series, spatial


def grid_labels(voxels: DataFrame, k: int) -> DataFrame:
    """About k starting cubes of equal side."""
    n = voxels.count()
    side = max(1, round(spatial.step_for(n, k)))
    key = F.struct(*[F.expr(f"{c} div {side}").alias(c) for c in "zyx"])
    names = voxels.select(key.alias("b")).distinct()
    named = names.withColumn("cid", F.xxhash64("b.x", "b.y", "b.z").bitwiseAND((1 << 40) - 1) + 1)
    return groups.dense(voxels.select("vid", key.alias("b")).join(named, "b").select("vid", "cid"))


#: Scales of features: z-scores over time, length one, or as they are.
NORMS = {"zscale": lambda: series.scaled("ts"), "l2": lambda: V.unit("ts"), "none": lambda: F.col("ts")}


def slic(voxels: DataFrame, k: int, weight: float = 10.0, most: int = 10, norm: str = "zscale", components: int = 0, relocate: int = 0, preserve_k: bool = False, connected: bool = True) -> DataFrame:
    """(vid, cid): windowed assignment and means, until fewer than one voxel in a hundred moves.

    Seeds are spaced Poisson voxels topped up by the grid's, moved to the least gradient within `relocate` voxels; `components` > 0 projects the features
    at random first; islands are handed over; with `preserve_k` labels that were lost come back as splits of the largest.
    """
    from gridfuse.operators import embed, exact, local, methods, seeds

    if norm not in NORMS:
        raise ValueError(f"norm must be one of {sorted(NORMS)}")
    rows = voxels.select("vid", "x", "y", "z", NORMS[norm]().alias("ts"))
    if components:
        rows = rows.drop("ts").join(embed.random_projection(rows, methods.times(voxels), components), "vid")
    rows = graph.saved(rows)
    n = rows.count()
    step = seeds.spacing(rows, k) or 1.0
    first = graph.saved(seeds.poisson(rows, k, step))
    starts = seeds.numbered(seeds.farthest(rows, first.select("vid"), k)) if first.count() < k else first
    if relocate:
        starts = seeds.relocated(starts, local.gradient(rows, "difference"), rows, relocate)
    centers = starts.join(rows, "vid").select("cid", F.col("ts").alias("feat"), *[F.col(c).cast("double").alias(f"c{c}") for c in "xyz"])
    labels = None
    for _ in range(most):
        new = spatial.assign(rows, graph.saved(centers), step, weight)
        if labels is None:
            labels = graph.saved(new)
        else:
            new = graph.saved(local.kept_or(labels, new))
            moved, labels = new.filter("moved").count(), new.select("vid", "cid")
            if moved * 100 < n:
                break
        centers = groups.centers(rows, labels)
    if connected:
        labels = graph.saved(local.islands(labels, spatial.grid_edges(rows, 26)))
    return exact.exact_k(rows, labels, k) if preserve_k else groups.dense(labels)


def rena(voxels: DataFrame, k: int, connectivity: int = 26, exact_k: bool = True) -> DataFrame:
    """(vid, cid): nearest neighbours among the `connectivity` nearest voxels merge, round after round, down to k clusters.

    The last round merges only as many of the closest pairs as lead to k.
    """
    from gridfuse.operators import merge  # it builds on this module's neighbours

    edges = spatial.knn_edges(voxels, connectivity).withColumn("w", F.lit(0.0))
    labels, _, _ = merge.coarsen(merge.leaves(voxels), edges, k, exact=exact_k, weighted=False)
    return groups.dense(labels.withColumn("cid", F.col("cid") + 1))


def cluster(voxels: DataFrame, k: int, method: str = "slic", **options) -> DataFrame:
    """Labels (vid, cid) of voxels (vid, x, y, z, ts) by a method of `methods.METHODS`."""
    from gridfuse.operators.methods import METHODS  # it builds on this module

    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    if not (isinstance(k, int) and k > 0 and not math.isinf(k)):
        raise ValueError("k must be a positive integer")
    missing = {"vid", "x", "y", "z", "ts"} - set(voxels.columns)
    if missing:
        raise ValueError(f"voxels lack {sorted(missing)}")
    return METHODS[method](voxels.select("vid", "x", "y", "z", "ts"), k, **options)
