"""Segmentations slice by slice: one forest a slice inside grouped tasks, fusion of several runs, exact numbers a slice, parts stitched over z.

A slice, not the volume, is what a task holds; everything between slices is a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import forest, graph, groups, merge, spatial


def slice_edges(voxels: DataFrame, diagonal: bool = True, size: tuple[float, float] = (1.0, 1.0), beta: float = 0.0) -> DataFrame:
    """(src, dst, f): neighbours in a slice, over its diagonals too if asked; f = 1 + beta * (length / shorter side - 1)."""
    moves = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if diagonal else [])]
    longer = [(sum((d * s) ** 2 for d, s in zip(m, size, strict=True)) ** 0.5) / min(size) - 1 for m in moves]
    o = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 + beta * extra).alias("f")) for (dx, dy), extra in zip(moves, longer, strict=True)]))
    asked = voxels.select("vid", "x", "y", "z", o.alias("o")).select(F.col("vid").alias("src"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "z", "o.f")
    return asked.join(voxels.select(F.col("vid").alias("dst"), "x", "y", "z"), ["x", "y", "z"]).select("src", "dst", "f")


def kruskal(rows: pd.DataFrame, scale: float, min_size: int, most: int) -> dict[int, int]:
    """Parts of one slice: edges (src, dst, w, h) in their order unite parts that both hold them no dearer than their own dearest edge plus scale over size.
    Then parts under min_size join the part beyond their cheapest edge, pass after pass."""
    ids = np.unique(rows[["src", "dst"]].to_numpy())
    edges = rows[rows["src"] != rows["dst"]].sort_values(["w", "h", "src", "dst"])
    a, b = (np.searchsorted(ids, edges[c].to_numpy()).tolist() for c in ("src", "dst"))
    prices = edges["w"].tolist()
    root, size, inner = list(range(len(ids))), [1] * len(ids), [0.0] * len(ids)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(i: int, j: int, w: float) -> None:
        i, j = min(i, j), max(i, j)
        root[j] = i
        size[i] += size[j]
        inner[i] = max(inner[i], inner[j], w)

    for i, j, w in zip(a, b, prices, strict=True):
        i, j = find(i), find(j)
        if i != j and w <= inner[i] + scale / size[i] and w <= inner[j] + scale / size[j]:
            unite(i, j, w)
    for _ in range(most if min_size > 1 else 0):
        best: dict[int, tuple[int, float]] = {}
        for i, j, w in zip(a, b, prices, strict=True):  # the first edge met is the cheapest
            i, j = find(i), find(j)
            if i != j:
                for here, there in ((i, j), (j, i)):
                    if size[here] < min_size:
                        best.setdefault(here, (there, w))
        if not best:
            break
        for here, (there, w) in best.items():
            i, j = find(here), find(there)
            if i != j:
                unite(i, j, w)
    return {int(v): int(ids[find(i)]) for i, v in enumerate(ids)}


def segment_slices(voxels: DataFrame, edges: DataFrame, scale: float, min_size: int = 1, most: int = 32) -> DataFrame:
    """(vid, cid): parts of each slice, named by their smallest voxel, from edges (src, dst, w) within slices."""
    low, high = F.least("src", "dst").cast("long"), F.greatest("src", "dst").cast("long")
    priced = edges.groupBy(low.alias("src"), high.alias("dst")).agg(F.min("w").alias("w")).withColumn("h", forest.pair_hash("src", "dst"))
    own = voxels.select(F.col("vid").cast("long").alias("src"), F.col("vid").cast("long").alias("dst"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("h"))
    rows = priced.union(own).join(voxels.select(F.col("vid").alias("src"), "z"), "src")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kruskal(group, scale, min_size, most).items(), columns=["vid", "cid"])

    return rows.select("z", "src", "dst", "w", "h").groupBy("z").applyInPandas(run, "vid long, cid long")


def fused_edges(voxels: DataFrame, runs: list[tuple[DataFrame, DataFrame | None]], sketches: list[DataFrame] | None = None, share: float = 0.7, diagonal: bool = True, size: tuple[float, float] = (1.0, 1.0), beta: float = 0.0) -> DataFrame:
    """(src, dst, w) within slices: share * (1 - co-membership) + (1 - share) * (1 - cosine of sketches), in 0..2.

    Co-membership is the share of runs (vid, cid) that keep two voxels together, by products of the voxels' weights (vid, w) where a run has
    them; labels of 0 belong to no part. Without `sketches` (vid, ts) of each run it counts alone.
    """
    rows = None
    for i, (labels, weights) in enumerate(runs):
        one = labels.select("vid", F.col("cid").alias("c"))
        one = one.withColumn("g", F.lit(1.0)) if weights is None else one.join(weights.select("vid", F.col("w").cast("double").alias("g")), "vid")
        one = one.withColumn("u", F.array().cast("array<double>")) if sketches is None else one.join(sketches[i].select("vid", V.unit_strict("ts").alias("u")), "vid")
        one = one.select("vid", F.lit(i).alias("run"), "c", "g", "u")
        rows = one if rows is None else rows.union(one)
    # All runs of a voxel stand in one row: as many as there are runs.
    members = graph.saved(rows.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("run", "c", "g", "u"))).alias("m")))
    pairs = slice_edges(voxels, diagonal, size, beta)
    both = pairs.join(members.select(F.col("vid").alias("src"), F.col("m").alias("a")), "src").join(members.select(F.col("vid").alias("dst"), F.col("m").alias("b")), "dst")
    one = lambda p, q: F.struct((p.g * q.g).alias("g"), ((p.c == q.c) & (p.c != 0)).alias("same"), V.dot(p.u, q.u).alias("r"))
    both = both.select("src", "dst", "f", F.filter(F.zip_with("a", "b", one), lambda s: s.g > 0).alias("s"))
    total = lambda of: F.aggregate("s", F.lit(0.0), lambda acc, s: acc + of(s))
    parts = both.select("src", "dst", "f", total(lambda s: s.g).alias("z"), total(lambda s: F.when(s.same, s.g).otherwise(0.0)).alias("c"), total(lambda s: s.g * s.r).alias("r"))
    ratio = lambda c: F.when(F.col("z") > 0, F.col(c) / F.col("z")).otherwise(0.0)
    d = 1 - ratio("c") if sketches is None else share * (1 - ratio("c")) + (1 - share) * (1 - ratio("r"))
    return parts.select("src", "dst", F.least(F.greatest(d * F.col("f"), F.lit(0.0)), F.lit(2.0)).alias("w"))


def part_prices(voxels: DataFrame, parts: DataFrame, vertical: bool, diagonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mean features of parts (vid, n, ts, inner), and (src, dst, w) of parts that touch, w = 1 - cosine of the means."""
    nodes = graph.saved(merge.pooled(merge.leaves(voxels), parts))
    touching = spatial.region_pairs(voxels, parts.withColumn("cid", F.col("cid") + 1), diagonal, vertical).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))
    return nodes, graph.saved(merge.priced(nodes, touching.withColumn("w", F.lit(0.0)), "cosine").withColumnRenamed("d", "w"))


def k_per_slice(voxels: DataFrame, parts: DataFrame, k: int, diagonal: bool = True) -> DataFrame:
    """(vid, cid): parts of slices, united in the order of the similarities that they start with until each slice has k of them (or no pair is left)."""
    nodes, prices = part_prices(voxels, parts, vertical=False, diagonal=diagonal)
    names, tree = forest.spanning(nodes.select("vid"), prices)
    where = graph.saved(voxels.join(parts, "vid").select("z", F.col("cid").alias("src")).distinct())
    at = tree.join(where, "src")
    # A slice has as many edges too many as it falls short of k parts with all of them.
    whole = where.groupBy("z").agg(F.count("*").alias("parts")).join(at.groupBy("z").agg(F.count("*").alias("edges")), "z", "left")
    short = whole.select("z", (k - F.col("parts") + F.coalesce("edges", F.lit(0))).alias("drop"))
    rank = F.row_number().over(Window.partitionBy("z").orderBy(*[F.col(c).desc() for c in ("w", "h", "src", "dst")]))
    kept = at.withColumn("rank", rank).join(short, "z").filter(F.col("rank") > F.col("drop"))
    joined, _ = forest.spanning(nodes.select("vid"), kept.select("src", "dst", "w"))
    return parts.join(joined.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", F.col("new").alias("cid"))


def stitched(voxels: DataFrame, parts: DataFrame, theta: float = 0.85, min_contact: int = 1) -> DataFrame:
    """(vid, cid): parts of neighbouring slices unite where the cosine of their means is `theta` or more and at least `min_contact` voxels of one lie right over the other."""
    nodes = graph.saved(merge.pooled(merge.leaves(voxels), parts))
    at = voxels.select("vid", "x", "y", "z").join(parts, "vid")
    over = at.select("x", "y", (F.col("z") + 1).alias("z"), F.col("cid").alias("src")).join(at.select("x", "y", "z", F.col("cid").alias("dst")), ["x", "y", "z"]).filter("src <> dst")
    contact = over.groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= min_contact)
    alike = merge.priced(nodes, contact.select("src", "dst", F.lit(0.0).alias("w")), "cosine").filter(F.col("d") <= 1 - theta).withColumnRenamed("d", "w")
    joined, _ = forest.spanning(nodes.select("vid"), alike)
    return parts.join(joined.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", F.col("new").alias("cid"))


def fuse(voxels: DataFrame, runs: list[tuple[DataFrame, DataFrame | None]], scale: float = 0.3, min_size: int = 80, sketches: list[DataFrame] | None = None, share: float = 0.7, k: int | None = None, k_slice: int | None = None, stitch: bool = False, diagonal: bool = True) -> DataFrame:
    """(vid, cid), from 1 up: what several runs agree on, slice by slice; with `sketches`, then k parts of the volume (over slices with `stitch`) or `k_slice` of each slice."""
    if len(runs) < 2:
        raise ValueError("fusion needs two runs or more")
    if (k or k_slice) and sketches is None:
        raise ValueError("an exact number of parts needs sketches")
    parts = graph.saved(segment_slices(voxels, fused_edges(voxels, runs, sketches, share, diagonal), scale, min_size))
    if k or k_slice:
        mean = None
        for i, (_, weights) in enumerate(runs):
            one = sketches[i].select("vid", F.posexplode(V.unit_strict("ts")).alias("t", "v"))
            one = one.withColumn("g", F.lit(1.0)) if weights is None else one.join(weights.select("vid", F.col("w").alias("g")), "vid")
            mean = one if mean is None else mean.union(one)
        sums = mean.groupBy("vid", "t").agg((F.sum(F.col("v") * F.col("g")) / F.greatest(F.sum("g"), F.lit(1e-12))).alias("v"))
        rows = sums.groupBy("vid").agg(V.unit(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v)).alias("ts"))
        rows = graph.saved(voxels.select("vid", "x", "y", "z").join(rows, "vid"))
        if k_slice:
            return groups.dense(k_per_slice(rows, parts, k_slice, diagonal).withColumn("cid", F.col("cid") + 1))
        nodes, prices = part_prices(rows, parts, vertical=stitch, diagonal=diagonal)
        named = merge.to_k(nodes, prices, k, "cosine")
        parts = parts.join(named.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", F.col("new").alias("cid"))
    return groups.dense(parts.withColumn("cid", F.col("cid") + 1))
