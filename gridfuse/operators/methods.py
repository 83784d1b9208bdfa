"""Clustering methods. All are loops of joins and grouped sums; region growing and agglomeration go in rounds instead of by one queue."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import cluster, embed, exact, flow, forest, graph, groups, growth, local, louvain, merge, neighbours, seeds, series, slices, spatial, spectral


def times(voxels: DataFrame) -> int:
    row = voxels.select(F.size("ts").alias("n")).first()
    if row is None:
        raise ValueError("no voxels")
    return row.n


def with_ts(voxels: DataFrame, ts: DataFrame) -> DataFrame:
    return graph.saved(voxels.select("vid", "x", "y", "z").join(spatial.unsent(ts), "vid"))


def supervoxels(voxels: DataFrame, k: int, alpha: float = 0.5, sigma1: float | None = None, sigma2: float = 2.5, rounds: int = 10, tol: float = 0.001, start: DataFrame | None = None) -> DataFrame:
    """Kernel scores of z-scored series against the centers around, from k-means of the places (or `start`), until a share under `tol` of the voxels moves.

    Unless given, sigma1 is the root of the number of samples, so that z-scores of unlike series, 2 a sample apart, still weigh exp(-1)."""
    sigma1 = math.sqrt(times(voxels)) if sigma1 is None else sigma1
    voxels = graph.saved(voxels.withColumn("ts", F.when(F.size("ts") > 1, series.scaled("ts")).otherwise(F.col("ts"))))
    n = voxels.count()
    radius = (3 if k >= 20 else max(4, 3 + 10 / k)) * 0.9 * max(1.0, seeds.spacing(voxels, k))
    labels = graph.saved(seeds.lloyd(voxels, seeds.even_starts(voxels, k), 5)[0]) if start is None else start
    for _ in range(rounds):
        found = local.assign_within(voxels, groups.centers(voxels, labels), radius, local.heat_score(alpha, sigma1, sigma2))
        new = graph.saved(local.kept_or(labels, found))
        labels = new.select("vid", "cid")
        if new.filter("moved").count() < tol * n:
            break
    return groups.dense(labels)


def snic(voxels: DataFrame, k: int, compactness: float = 5.0) -> DataFrame:
    """Seeds grow over the 26 neighbours, cheapest offers first, by |offset|**2 / step**2 + |feature difference|**2 / compactness; step is 1.1 times the seeds' spacing."""
    step = 1.1 * seeds.spacing(voxels, k)
    rows = graph.saved(voxels.withColumn("ts", F.when(F.size("ts") > 1, series.scaled("ts")).otherwise(F.col("ts"))))
    starts = graph.saved(seeds.initial(rows, k, "gradient", local.gradient(rows, "difference")))
    # Voxels are z-scores while the centers have length one, so features cost by their angle.
    return groups.dense(growth.grow_in_slabs(rows, starts, spatial.grid_edges(rows, 26), growth.offset_price(step * step, compactness), unit=True))


def g3s(voxels: DataFrame, k: int, alpha: float = 0.5, components: int = 15, refinements: int = 3) -> DataFrame:
    """Leading components; seeds at low gradients; growth by alpha * (1 - cosine) + (1 - alpha) * distance / step; refined boundaries."""
    rows = with_ts(voxels, embed.compressed(voxels, components))
    edges = graph.saved(spatial.grid_edges(rows, 26))
    gradient = graph.saved(local.functional_gradient(rows, spatial.knn(rows, 26)))
    price = growth.cosine_price(alpha, math.sqrt(seeds.spacing(rows, k) ** 3))
    starts = graph.saved(seeds.low_gradient(rows, gradient, k, 0.5, fill="index"))
    return groups.dense(local.refine(rows, growth.grow_in_slabs(rows, starts, edges, price, ahead=True), edges, refinements))


def corr_slic(voxels: DataFrame, k: int, alpha: float = 0.1, dimensions: int = 16, basis: str = "hash", rounds: int = 6, connected: bool = True) -> DataFrame:
    """Windowed assignment of unit sketches: 1 - product + alpha * |offset|**2 / step**2; islands are handed over at the end."""
    n_time = times(voxels)
    made = embed.count_sketch(voxels, n_time, dimensions) if basis == "hash" else embed.cosine_embedding(voxels, n_time, min(dimensions, n_time - 1))
    rows = with_ts(voxels, made)
    n = rows.count()
    step = spatial.step_for(n, k)
    starts = seeds.axis_grid(rows, k).join(rows, "vid").select("cid", F.col("ts").alias("feat"), *[F.col(c).cast("double").alias(f"c{c}") for c in "xyz"])
    price = 1 - V.dot("ts", "feat") + alpha * local.space() / (step * step)
    labels = graph.saved(local.nearest_center(rows, graph.saved(starts), step, price))
    for _ in range(rounds - 1):
        new = graph.saved(local.kept_or(labels, local.nearest_center(rows, graph.saved(groups.unit_centers(rows, labels)), step, price)))
        labels = new.select("vid", "cid")
        if new.filter("moved").count() < 0.001 * n:
            break
    return groups.dense(local.islands(labels, spatial.grid_edges(rows, 6), max(10, round(step**3 / 4))) if connected else labels)


def brs_slic(voxels: DataFrame, k: int, alpha: float = 0.05, dimensions: int = 24, passes: int = 1, l2: float = 0.0, global_passes: int = 0) -> DataFrame:
    """Coarse `corr_slic`, then passes on the series themselves: at the boundaries with the labels around, and, if asked, of all voxels with the centers around."""
    n_time = times(voxels)
    edges, step, stride = graph.saved(spatial.grid_edges(voxels, 6)), spatial.step_for(voxels.count(), k), 2 if n_time >= 40 else 1
    labels = graph.saved(corr_slic(voxels, k, alpha, dimensions, rounds=2, connected=False))
    passed = [lambda at: local.boundary_step(voxels, at, edges, step, alpha, l2, stride)] * passes + [lambda at: local.exact_step(voxels, at, None, step, alpha, stride)] * global_passes
    for one in passed:
        new = graph.saved(one(labels))
        labels = new.select("vid", "cid")
        if new.filter("moved").isEmpty():
            break
    return groups.dense(local.islands(labels, edges, max(10, round(step**3 / 4))))


def slice_run(voxels: DataFrame, compactness: float = 2.0, r: int = 48, min_size: int = 1, smooth: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One raw run: (vid, cid) parts of slices, (vid, w) reliabilities and (vid, ts) cosine sketches, smoothed over z if asked."""
    n_time = times(voxels)
    rows = with_ts(voxels, embed.sketch(voxels, n_time, min(n_time - 1, r)))
    if smooth > 0:
        long = rows.select("vid", "x", "y", "z", F.posexplode("ts").alias("t", "v"))
        parts = long.join(long.select("x", "y", (F.col("z") + 1).alias("z"), "t", F.col("v").alias("lo")), ["x", "y", "z", "t"], "left").join(long.select("x", "y", (F.col("z") - 1).alias("z"), "t", F.col("v").alias("hi")), ["x", "y", "z", "t"], "left")
        mixed = parts.select("vid", "t", ((1 - smooth) * F.col("v") + smooth / 2 * (F.coalesce("lo", "v") + F.coalesce("hi", "v"))).alias("v"))
        rows = with_ts(voxels, embed.gathered(mixed, "vid", "t", "v").select("vid", V.unit("ts").alias("ts")))
    pairs = slices.slice_edges(rows)
    edges = spatial.with_features(pairs, rows).select("src", "dst", F.least(F.greatest(1 - V.dot("a", "b"), F.lit(0.0)), F.lit(2.0)).alias("w"))
    labels = graph.saved(slices.segment_slices(rows, edges, 2.0 / (compactness + 1), min_size))
    return labels, voxels.select("vid", series.split_half("ts").alias("w")), rows.select("vid", "ts")


def slice_msf(voxels: DataFrame, k: int, compactness: float = 2.0, r: int = 48, min_size: int | None = None, runs: int = 1, retries: int = 2) -> DataFrame:
    """Forests of slices over cosine sketches, then parts that touch, over slices too, unite by cosine to k; several runs (of growing smoothness over z) are fused first.

    With too few parts it is run again, `retries` times, with twice the compactness and half the least size.
    """
    n = voxels.count()
    min_size = max(1, n // (8 * k)) if min_size is None else min_size
    for attempt in range(retries + 1):
        made = [slice_run(voxels, compactness, r, min_size, 0.3 * i) for i in range(max(1, runs))]
        rows = with_ts(voxels, made[0][2])
        labels = made[0][0]
        if len(made) > 1:
            edges = slices.fused_edges(rows, [(one.withColumn("cid", F.col("cid") + 1), None) for one, _, _ in made], [s for _, _, s in made])
            labels = graph.saved(slices.segment_slices(rows, edges, 2.0 / (compactness + 1), min_size))
        if attempt == retries or labels.select("cid").distinct().count() >= k:
            break
        compactness, min_size = compactness * 2, max(1, min_size // 2)
    nodes, prices = slices.part_prices(rows, labels, vertical=True)
    named = merge.to_k(nodes, prices, k, "cosine")
    return groups.dense(renamed(labels, named))


def renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(vid, cid), from 1 up: labels of labels."""
    return labels.join(names.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", (F.col("new") + 1).alias("cid"))


def rena_plus(voxels: DataFrame, k: int, r: float = 2.0, connectivity: int = 26, image: DataFrame | None = None, penalty: float = 1.0) -> DataFrame:
    """Nearest neighbours unite down to about r * k parts, an image (vid, g) making its edges dearer; then neighbours merge by Ward's cost to k, cheapest merges of all first."""
    edges = spatial.grid_edges(voxels, connectivity).withColumn("w", F.lit(0.0))
    coarse, nodes, left = merge.coarsen(merge.leaves(voxels), edges, max(1, math.ceil(r * k)), image, penalty, exact=True)
    named = merge.to_k(nodes, left, k, "ward")
    return groups.dense(renamed(coarse, named))


def flash3d(voxels: DataFrame, k: int, weight: float = 0.6, weight_t: float = 1.0, rounds: int = 2, bits: int = 64, coefficients: int = 12) -> DataFrame:
    """Hash bits and jump flooding: with strides that halve, a voxel takes the best seed among those that its neighbours carry."""
    n_time = times(voxels)
    rows = graph.saved(voxels.select("vid", "x", "y", "z").join(embed.hash_bits(voxels, n_time, min(coefficients, n_time), bits), "vid"))
    s2 = spatial.step_for(rows.count(), k) ** 2
    side = max(v or 1 for v in rows.agg(*[F.max(c) - F.min(c) + 1 for c in "xyz"]).first())
    at, majority = graph.saved(seeds.cell_members(voxels, k)), None
    for i in range(rounds):
        placed = at.join(rows, "vid").select("cid", *[F.col(c).alias(f"c{c}") for c in "xyz"], F.col("h").alias("g"))
        if majority is not None:
            placed = placed.join(majority, "cid").withColumn("g", F.col("major")).drop("major")
        centers = graph.saved(placed)
        carried = graph.saved(at.select("vid", "cid"))
        price = weight * (1 + i / 2) * local.space() / s2 + weight_t * V.hamming(F.col("h"), F.col("g")) / bits
        stride = 2 ** math.ceil(math.log2(side)) if side > 1 else 1
        while stride >= 1:
            carried = graph.saved(local.relaxed(rows, carried, centers, stride, price))
            stride //= 2
        # The next seeds are the members nearest to the middle of each part, with the bits that most members have.
        middle = carried.join(rows, "vid").groupBy("cid").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
        at = graph.saved(carried.join(rows, "vid").join(middle, "cid").groupBy("cid").agg(F.min(F.struct(local.space().alias("d"), F.col("vid"))).alias("m")).select(F.col("m.vid").alias("vid"), "cid"))
        majority = graph.saved(groups.bit_majority(rows.select("vid", "h"), carried).select("cid", F.col("h").alias("major")))
    return groups.dense(carried)


def mcl(voxels: DataFrame, k: int, spatial_weight: float = 0.2, inflation: float = 1.6, connectivity: int = 6, rounds: int = 8) -> DataFrame:
    """Markov clustering of the grid graph; k sets how many entries a column keeps (16 to 64), not the number of clusters."""
    edges = spatial.weighted_graph(voxels, connectivity, spatial_weight)
    return groups.dense(flow.markov(voxels, edges, inflation, min(64, max(16, k)), rounds=rounds).withColumn("cid", F.col("cid") + 1))


def acsc(voxels: DataFrame, k: int, block: int = 2, refinements: int = 5, near: int = 10, alpha: float = 0.5, weighting: str = "gaussian", projection: str | None = None, components: int = 0, metric: str | None = None) -> DataFrame:
    """Communities of a graph of block means: each block's nearest by features, weighted with their places, at the resolution that gives about k; then refined boundaries.

    With a `metric` series are cleaned first (`series.clean_for_blocks`)."""
    voxels = voxels if metric is None else graph.saved(series.clean_for_blocks(voxels, metric))
    edges, nodes, own = neighbours.block_graph(voxels, block, near, alpha, weighting, projection, components)
    found, _, _ = louvain.to_k(nodes.select("vid"), edges, k)
    labels = own.join(found.select(F.col("vid").alias("cid"), F.col("cid").alias("new")), "cid").select("vid", F.col("new").alias("cid"))
    grid = graph.saved(spatial.grid_edges(voxels, 26))
    return groups.dense(local.refine(voxels, groups.dense(labels), grid, refinements, fixed=True))


def commute_weights(voxels: DataFrame, near: int = 27, alpha: float = 0.5, sigma1: float = 0.73, sigma2: float = 5.0, mode: str = "binary") -> DataFrame:
    """(src, dst, w): among each other's `near` nearest places within 6 * sigma2: alpha * kernel of features + (1 - alpha) * closeness (1, or with "heat" a kernel of the distance),
    every row divided by its sum and the two directions averaged."""
    if mode not in ("binary", "heat"):
        raise ValueError("mode must be binary or heat")
    # Within the reach of the nearest: a voxel's own place counts as one of them.
    found = spatial.knn(voxels, max(1, near - 1)).filter(F.col("d") <= 6 * sigma2)
    rows = spatial.with_features(found.select("src", "dst", "d"), voxels)
    close = F.lit(1.0) if mode == "binary" else V.heat(F.col("d") * F.col("d"), sigma2)
    w = alpha * V.normalised_heat(V.sq_distance("a", "b"), F.size("a"), sigma1) + (1 - alpha) * close
    one = rows.select("src", "dst", w.alias("w"))
    share = one.join(one.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all") / 2).alias("w"))
    return share.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def commute(voxels: DataFrame, k: int, connectivity: int = 27, components: int | None = None, alpha: float = 0.5, sigma1: float = 0.73, sigma2: float = 5.0, mode: str = "binary", starts: int = 10, seed: int = 1, tolerance: float = 1e-3) -> DataFrame:
    """The best of several k-means of the commute-time embedding of a graph of places and features."""
    n = voxels.count()
    m = components or math.ceil(math.sqrt(2 * k))
    rows = graph.saved(voxels.withColumn("ts", F.when(F.size("ts") > 1, series.scaled(V.repaired("ts", F.col("vid"), seed))).otherwise(F.col("ts"))))
    edges = graph.saved(commute_weights(rows, connectivity, alpha, sigma1, sigma2, mode))
    made, _ = spectral.commute_times(rows.select("vid"), edges, min(m, n - 1), tolerance=tolerance)
    features = graph.saved(made.select("vid", "ts")).select("vid", array_to_vector("ts").alias("features")).persist()
    fits = (KMeans(k=k, seed=seed + i, maxIter=50).fit(features) for i in range(starts))
    best = min(fits, key=lambda fit: fit.summary.trainingCost)
    labels = graph.saved(best.transform(features).select("vid", (F.col("prediction") + 1).alias("cid")))
    features.unpersist()
    return groups.dense(labels)


def votes(voxels: DataFrame, partitions: list[DataFrame]) -> DataFrame:
    """(src, dst, w): the share of partitions that keep two neighbours apart."""
    edges = graph.saved(spatial.grid_edges(voxels, 6))
    rows = None
    for labels in partitions:
        a = labels.select(F.col("vid").alias("src"), F.col("cid").alias("a"))
        pairs = edges.join(a, "src").join(a.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
        one = pairs.select("src", "dst", F.expr("CAST(a <> b AS DOUBLE)").alias("w"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("src", "dst").agg(F.avg("w").alias("w"))


def consensus(voxels: DataFrame, partitions: list[DataFrame], k: int) -> DataFrame:
    """(vid, cid): the spanning forest of the votes without its dearest edges, so that k parts are left."""
    _, tree = forest.spanning(voxels.select("vid"), votes(voxels, partitions))
    return groups.dense(forest.cut(voxels.select("vid"), tree, k).withColumn("cid", F.col("cid") + 1))


def meta(centers: DataFrame, cuts: list[int] | None = None, distance: str = "correlation") -> DataFrame:
    """(cid, k, meta): clusters of clusters, by Ward's linkage of the features of all centers."""
    return exact.hierarchy(centers, cuts or exact.default_cuts(centers.count()), distance)


METHODS = {"slic": cluster.slic, "rena": cluster.rena} | {f.__name__: f for f in (supervoxels, snic, g3s, corr_slic, brs_slic, slice_msf, rena_plus, flash3d, mcl, acsc, commute)}
