"""Exactly k clusters from any labels: Ward's merging of centers if there are too many, splits of the largest if too few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, groups, local, merge, spatial

#: Most centers that are merged at once: their distances are held by one process, 8 * MOST**2 bytes.
MOST = 4096


def linkage(distance: np.ndarray, weights: np.ndarray | None = None, squared: bool = True) -> list[tuple[int, int, float]]:
    """Ward's merges (a, b, height), b going into a, of points with these distances, nearest first; ties to the smaller numbers.

    With `squared` the update works on squared distances and heights are distances again (the form known as D2), else on the distances as they are.
    """
    d = distance.astype(float) ** 2 if squared else distance.astype(float).copy()
    n = len(d)
    size = np.ones(n) if weights is None else weights.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, merges = np.ones(n, bool), []
    for _ in range(n - 1):
        a, b = np.unravel_index(np.argmin(d), d.shape)
        a, b = min(a, b), max(a, b)
        height, others = d[a, b], alive.copy()
        others[[a, b]] = False
        total = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * height) / total
        d[a, others] = d[others, a] = new[others]
        d[b, :] = d[:, b] = np.inf
        size[a] += size[b]
        alive[b] = False
        merges.append((int(a), int(b), float(np.sqrt(height) if squared else height)))
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """The group, from 1 in order of first member, of each of n points after all but the last k - 1 merges."""
    name = np.arange(n)
    for a, b, _ in merges[: max(0, n - k)]:
        name[name == name[b]] = name[a]
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[which] + 1


def center_matrix(centers: DataFrame) -> tuple[list[int], np.ndarray]:
    if centers.count() > MOST:
        raise ValueError(f"over {MOST} centers: their distances would outgrow one process")
    rows = centers.select("cid", "feat").orderBy("cid").collect()
    return [r.cid for r in rows], np.array([r.feat for r in rows], float)


def merged(voxels: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Labels of at most k clusters, by Ward's linkage of the mean features."""
    ids, x = center_matrix(groups.centers(voxels, labels))
    if len(ids) <= k:
        return labels.select("vid", "cid")
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    names = voxels.sparkSession.createDataFrame([(i, int(g)) for i, g in zip(ids, cut(linkage(d), len(ids), k), strict=True)], "cid long, new int")
    return labels.join(F.broadcast(names), "cid").select("vid", F.col("new").alias("cid"))


def split_once(voxels: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Labels after each of the `most` largest clusters gave the members nearer to its farthest member than to its mean to a new cluster.

    Members are compared by features; a cluster of equal features gives one voxel.
    """
    top = graph.saved(groups.counts(labels).filter("n > 1").orderBy(F.desc("n"), "cid").limit(most))
    rows = voxels.select("vid", "ts").join(labels, "vid").join(F.broadcast(top.select("cid")), "cid")
    centers = groups.centers(voxels, labels.join(F.broadcast(top.select("cid")), "cid", "left_semi"))
    priced = graph.saved(rows.join(centers.select("cid", "feat"), "cid").withColumn("d", V.sq_distance("ts", "feat")))
    far = priced.groupBy("cid").agg(F.max(F.struct(F.round("d", 9).alias("d"), (-F.col("vid")).alias("v"))).alias("m"))
    far = far.select("cid", (-F.col("m.v")).alias("seed")).join(voxels.select(F.col("vid").alias("seed"), F.col("ts").alias("other")), "seed")
    moves = priced.join(far, "cid").filter((F.col("vid") == F.col("seed")) | (V.sq_distance("ts", "other") < F.col("d"))).select("vid", F.col("cid").alias("from"))
    shift = (labels.agg(F.max("cid")).first()[0] or 0) + 1
    return labels.join(moves, "vid", "left").select("vid", F.when(F.col("from").isNull(), F.col("cid")).otherwise(F.col("from") + shift).cast("long").alias("cid"))


def exact_k(voxels: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(vid, cid) with labels 1..k; k over the number of labelled voxels is lowered to that. Splits do not look at places."""
    labels = graph.saved(labels.filter("cid > 0").select("vid", F.col("cid").cast("long").alias("cid")))
    k = min(k, labels.count())
    found = labels.agg(F.countDistinct("cid")).first()[0]
    if found > k:
        return groups.dense(merged(voxels, labels, k))
    while found < k:
        labels = graph.saved(split_once(voxels, labels, k - found))
        found = labels.agg(F.countDistinct("cid")).first()[0]
    return groups.dense(labels)


def spread(voxels: DataFrame, labels: DataFrame) -> float:
    """Sum of squared distances of features to the means of their clusters."""
    rows = voxels.select("vid", "ts").join(labels, "vid").join(groups.centers(voxels, labels).select("cid", "feat"), "cid")
    return rows.agg(F.sum(V.sq_distance("ts", "feat"))).first()[0] or 0.0


def halved(voxels: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """(vid, cid): each cluster in two, 2 * cid and 2 * cid + 1, by k-means of its features from the member farthest from its mean and the one farthest from that."""
    rows = graph.saved(voxels.select("vid", "x", "y", "z", "ts").join(labels.select("vid", "cid"), "vid"))

    def far(at: DataFrame) -> DataFrame:
        order = F.struct(F.round(V.sq_distance("ts", "feat"), 9).alias("d"), (-F.col("vid")).alias("v"))
        return rows.join(at, "cid").groupBy("cid").agg(F.max_by("ts", order).alias("feat"))

    left = graph.saved(far(groups.centers(voxels, labels).select("cid", "feat")))
    ends = left.withColumnRenamed("feat", "f0").join(far(left).withColumnRenamed("feat", "f1"), "cid")
    side = (V.sq_distance("ts", "f1") < V.sq_distance("ts", "f0")).cast("long")
    for i in range(rounds):
        sided = graph.saved(rows.join(ends, "cid").select("vid", (2 * F.col("cid") + side).alias("cid")))
        if i < rounds - 1:
            means = graph.saved(groups.centers(voxels, sided).select(F.floor(F.col("cid") / 2).alias("cid"), (F.col("cid") % 2).alias("side"), "feat"))
            one, two = (means.filter(f"side = {s}").select("cid", F.col("feat").alias(f"f{s}")) for s in (0, 1))
            # A cluster of equal features stays whole.
            ends = one.join(two, "cid", "left").select("cid", "f0", F.coalesce("f1", "f0").alias("f1"))
    return sided


def resettled(voxels: DataFrame, labels: DataFrame, k: int, halvings: int = 2, refinements: int = 3, passes: int = 3) -> DataFrame:
    """(vid, cid): k clusters with a smaller spread than the labels', or of fewer connected parts, by splitting and merging; the labels themselves where none is found.

    Clusters are halved by features, connected parts of these become nodes, and the merges of neighbours of least Ward height leave k; voxels at boundaries then take
    the label around them of the nearest mean. Moves of single voxels cannot do this: two clusters that share one region hold each other in place.
    Where clusters lose all voxels at the end, others hold too much: `exact_k` splits these, and another pass follows.
    """
    edges = graph.saved(spatial.grid_edges(voxels, 26))
    both = graph.saved(spatial.both_ways(edges))
    found = labels
    for _ in range(passes):
        parts = found.select("vid", F.col("cid").cast("long").alias("cid"))
        for _ in range(halvings):
            parts = halved(voxels, parts)
        atoms = graph.saved(graph.fragments(parts, edges).withColumn("cid", F.col("cid") + 1))
        nodes = graph.saved(groups.centers(voxels, atoms).select(F.col("cid").alias("vid"), "n", F.col("feat").alias("ts"), F.lit(0.0).alias("inner")))
        named = merge.to_k(nodes, graph.contract(edges, atoms).withColumn("w", F.lit(0.0)), k, "ward")
        found = graph.saved(atoms.join(named.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", F.col("new").alias("cid")))
        for _ in range(refinements):
            asked = local.candidates(found, both).join(spatial.boundary(found, edges), "vid", "left_semi")
            new = graph.saved(local.kept_or(found, local.best(voxels, asked, groups.centers(voxels, found), -V.sq_distance("ts", "feat"))))
            found = new.select("vid", "cid")
            if new.filter("moved").isEmpty():
                break
        if groups.counts(found).count() == k:
            break
        found = graph.saved(exact_k(voxels, found, k))
    if groups.counts(found).count() != k:
        return labels
    if spread(voxels, found) >= spread(voxels, labels) * (1 - 1e-9):
        # Clusters of many places fit noise better than any of one place each.
        pieces = [graph.fragments(one.select("vid", F.col("cid").cast("long").alias("cid")), edges).select("cid").distinct().count() for one in (found, labels)]
        if pieces[0] >= pieces[1]:
            return labels
    return groups.dense(found)


def hierarchy(centers: DataFrame, cuts: list[int], distance: str = "correlation") -> DataFrame:
    """(cid, k, meta): the group of each center in cuts of Ward's linkage at several k; distances are 1 - correlation (0 correlation where a center is constant), or Euclidean."""
    if distance not in ("correlation", "euclid"):
        raise ValueError("distance must be correlation or euclid")
    ids, x = center_matrix(centers)
    if distance == "correlation":
        z = x - x.mean(1, keepdims=True)
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        d = 1 - (z / np.where(norm < 1e-12, 1, norm)) @ (z / np.where(norm < 1e-12, 1, norm)).T
    else:
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
    merges = linkage(np.maximum(d, 0), squared=False)
    rows = [(i, k, int(g)) for k in cuts for i, g in zip(ids, cut(merges, len(ids), k), strict=True)]
    return centers.sparkSession.createDataFrame(rows, "cid long, k int, meta int")


def default_cuts(k: int) -> list[int]:
    most = max(2, k // 2)
    return sorted({c for c in (2, min(5, most), min(10, most)) if c < k})
