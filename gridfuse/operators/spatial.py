"""Neighbourhoods on grids and among points: equi-joins on cells, never on all pairs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """The neighbours of a voxel that share a face (6), also an edge (18), also a corner (26 or 27)."""
    reach = {6: 1, 18: 2, 26: 3, 27: 3}[connectivity]
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= reach]


def unsent(df: DataFrame) -> DataFrame:
    """A table of about a row a voxel, which joins shuffle: a broadcast of it, however small its file, passes through the driver."""
    return df.hint("merge")


def grid_edges(voxels: DataFrame, connectivity: int = 6) -> DataFrame:
    """(src, dst), src < dst, of neighbours; half of the offsets are looked up by an equi-join on the cell."""
    half = [o for o in offsets(connectivity) if o[::-1] > (0, 0, 0)]
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in half]))
    moved = voxels.select(F.col("vid").alias("a"), "x", "y", "z", moves.alias("o")).select("a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("z") + F.col("o.dz")).alias("z"))
    found = moved.join(unsent(voxels.select(F.col("vid").alias("b"), "x", "y", "z")), ["x", "y", "z"])
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *edges.columns[2:]))


def with_features(edges: DataFrame, voxels: DataFrame) -> DataFrame:
    a = voxels.select(F.col("vid").alias("src"), F.col("ts").alias("a"))
    return edges.join(unsent(a), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("a").alias("b"))), "dst")


def edge_distances(edges: DataFrame, voxels: DataFrame) -> DataFrame:
    """(src, dst, d): squared distance of features, on the edges only."""
    return with_features(edges, voxels).select("src", "dst", V.sq_distance("a", "b").alias("d"))


def edge_similarity(edges: DataFrame, voxels: DataFrame) -> DataFrame:
    """(src, dst, w): (correlation + 1) / 2, or 0 where a side is constant."""
    r = V.correlation("a", "b")
    return with_features(edges, voxels).select("src", "dst", F.least(F.greatest((r + 1) / 2, F.lit(0.0)), F.lit(1.0)).alias("w"))


def nearest(voxels: DataFrame, k: int, reach: int, only: DataFrame | None = None) -> DataFrame:
    """(src, dst, rank, d): the k nearest grid neighbours within `reach` cells, of all voxels or `only` of some; ties go to the smaller vid.

    Exact where the k-th is no farther than `reach`; cells bound the candidates to (2 reach + 1)**3 a voxel.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    dealt = lambda v: v.select("vid", "x", "y", "z", cell("x").alias("i"), cell("y").alias("j"), cell("z").alias("k"))
    points = dealt(voxels)
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("di", "dj", "dk"), strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
    asked = (points if only is None else dealt(only)).withColumn("o", around).select(F.col("vid").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"))
    pairs = asked.join(points.withColumnRenamed("vid", "dst"), ["i", "j", "k"]).filter("src <> dst")
    d2 = sum((F.col(f"s{c}") - F.col(c)) * (F.col(f"s{c}") - F.col(c)) for c in "xyz")
    near = pairs.select("src", "dst", d2.alias("d2")).filter(F.col("d2") <= reach * reach)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).filter(F.col("rank") <= k)
    return ranked.select("src", "dst", "rank", F.sqrt("d2").alias("d"))


def knn(voxels: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, d): the k nearest voxels of each, however far; ties go to the smaller vid.

    Voxels with fewer than k within the reach are asked again with twice the reach, the others are settled.
    """
    from gridfuse.operators import graph  # imports this module

    places = voxels.select("vid", "x", "y", "z")
    span = max((v or 0) for v in places.agg(*[F.max(c) - F.min(c) for c in "xyz"]).first()) + 1
    reach, done, asked = max(1, math.ceil(k ** (1 / 3) / 2)), None, None
    while True:
        found = graph.saved(nearest(places, k, reach, asked))
        if reach >= 2 * span:
            return found if done is None else done.union(found)
        enough = graph.saved(found.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("src"))
        settled = found.join(enough, "src", "left_semi")
        done = settled if done is None else done.union(settled)
        asked = graph.saved((places if asked is None else asked).join(enough.withColumnRenamed("src", "vid"), "vid", "left_anti"))
        if asked.isEmpty():
            return done
        reach *= 2


def knn_edges(voxels: DataFrame, k: int) -> DataFrame:
    """(src, dst), src < dst, of voxels of which one is among the k nearest of the other."""
    return knn(voxels, k).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def heat_similarity(edges: DataFrame, voxels: DataFrame, sigma: float | None = None) -> DataFrame:
    """(src, dst, w): exp(-d / (2 sigma**2)) of the squared distance d; sigma is the median positive distance unless given."""
    d = edge_distances(edges, voxels)
    if sigma is None:
        sigma = d.filter("d > 0").agg(F.median(F.sqrt("d"))).first()[0] or 1.0
    return d.select("src", "dst", V.heat(F.col("d"), sigma).alias("w"))


def weighted_graph(voxels: DataFrame, connectivity: int = 6, spatial_weight: float = 0.2, metric: str = "correlation", feature_sigma: float | None = None, spatial_sigma: float | None = None, floor: float = 1e-6) -> DataFrame:
    """(src, dst, w): similarity of features and closeness of places, exp(-gap**2 / (2 sigma**2)), mixed by `spatial_weight`, at least `floor`."""
    if metric not in ("correlation", "heat"):
        raise ValueError("metric must be correlation or heat")
    edges = grid_edges(voxels, connectivity)
    near = edge_similarity(edges, voxels) if metric == "correlation" else heat_similarity(edges, voxels, feature_sigma)
    at = voxels.select(F.col("vid").alias("src"), F.struct("x", "y", "z").alias("a"))
    rows = near.join(at, "src").join(at.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    gap = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"))
    rows = rows.select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"), gap.alias("gap"))
    if spatial_sigma is None:
        spatial_sigma = rows.filter("gap > 0").agg(F.median("gap")).first()[0] or 1.0
    mixed = (1 - spatial_weight) * F.col("w") + spatial_weight * V.heat(F.col("gap") * F.col("gap"), spatial_sigma)
    return rows.select("src", "dst", F.greatest(mixed, F.lit(floor)).alias("w"))


#: Forward neighbours: three along the axes, and ten more that share an edge or a corner.
FORWARD = {6: [(1, 0, 0), (0, 1, 0), (0, 0, 1)], 26: [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (-1, 1, 0), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 1, 1), (-1, 1, 1), (1, -1, 1), (-1, -1, 1)]}


def forward_edges(voxels: DataFrame, neighbours: int = 26, size: tuple[float, float, float] = (1.0, 1.0, 1.0), beta: float = 0.0) -> DataFrame:
    """(src, dst, w): forward neighbours of unit features with (1 - cosine) * (1 + beta * (length / shortest side - 1)), within 0 and 2."""
    units = voxels.select("vid", "x", "y", "z", V.unit("ts").alias("ts"))
    least = min(size)
    longer = [math.sqrt(sum((d * s) ** 2 for d, s in zip(o, size, strict=True))) / least - 1 for o in FORWARD[neighbours]]
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz"), strict=True)], F.lit(1 + beta * extra).alias("f")) for o, extra in zip(FORWARD[neighbours], longer, strict=True)]))
    asked = units.select("vid", "x", "y", "z").withColumn("o", moves).select(F.col("vid").alias("src"), F.col("o.f").alias("f"), *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"])
    pairs = asked.join(units.select(F.col("vid").alias("dst"), "x", "y", "z"), ["x", "y", "z"]).select("src", "dst", "f")
    rows = with_features(pairs, units)
    return rows.select("src", "dst", F.least(F.greatest((1 - V.dot("a", "b")) * F.col("f"), F.lit(0.0)), F.lit(2.0)).alias("w"))


def region_pairs(voxels: DataFrame, labels: DataFrame, diagonal: bool = False, vertical: bool = True) -> DataFrame:
    """(src, dst), src < dst, of labels that touch: side by side in a slice, over its diagonals too if asked, and across slices if asked."""
    moves = [(1, 0, 0), (0, 1, 0), *([(1, 1, 0), (-1, 1, 0)] if diagonal else []), *([(0, 0, 1)] if vertical else [])]
    at = voxels.select("vid", "x", "y", "z").join(labels.filter("cid > 0").select("vid", "cid"), "vid")
    o = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(m, ("dx", "dy", "dz"), strict=True)]) for m in moves]))
    asked = at.withColumn("o", o).select(F.col("cid").alias("a"), *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"])
    pairs = asked.join(at.select("x", "y", "z", F.col("cid").alias("b")), ["x", "y", "z"]).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def boundary(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid): voxels with a neighbour of another label."""
    a = labels.select(F.col("vid").alias("src"), F.col("cid").alias("ca"))
    found = edges.join(unsent(a), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("ca").alias("cb"))), "dst").filter("ca <> cb")
    return found.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()


def assign(voxels: DataFrame, centers: DataFrame, step: float, weight: float) -> DataFrame:
    """(vid, cid): the center of least |feature difference|**2 + weight**2 |offset|**2 / step**2 in the 27 cells of size 2 * step around; the nearest of all where none is there.

    Centers are dealt to cells, so a voxel meets only those near it.
    """
    from gridfuse.operators import graph  # imports this module

    size = 2.0 * step
    cells = [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in zip(("cx", "cy", "cz"), "ijk", strict=True)]
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("di", "dj", "dk"), strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
    spread = centers.select("cid", "feat", "cx", "cy", "cz", *cells).withColumn("o", around).select("cid", "feat", "cx", "cy", "cz", *[(F.col(n) + F.col(f"o.d{n}")).alias(n) for n in "ijk"])
    points = voxels.select("vid", "ts", "x", "y", "z", *[F.floor(F.col(c) / size).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    space = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    cost = V.sq_distance("ts", "feat") + space * (weight * weight / (step * step))
    best = points.join(spread, list("ijk")).groupBy("vid").agg(F.min(F.struct(cost.alias("cost"), F.col("cid"))).alias("m")).select("vid", F.col("m.cid").alias("cid"))
    best = graph.saved(best)
    rest = voxels.select("vid", "ts", "x", "y", "z").join(best, "vid", "left_anti")
    if rest.isEmpty():
        return best
    # Far from all centers: every one is tried, and only the best of each task is dealt out.
    far = rest.crossJoin(centers.select("cid", "feat", "cx", "cy", "cz")).groupBy("vid").agg(F.min(F.struct(cost.alias("cost"), F.col("cid"))).alias("m"))
    return best.union(far.select("vid", F.col("m.cid").alias("cid")))


def step_for(n: int, k: int) -> float:
    """Side of the cube that each of k clusters has of n voxels."""
    return max(1.0, math.pow(n / k, 1 / 3))
